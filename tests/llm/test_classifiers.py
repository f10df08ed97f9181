"""Toxicity and quality: held-out accuracy, the counterfactual term, brute-force voting."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfold.llm import quality, toxicity
from sparkfold.llm.frames import table


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.1"
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").orderBy("doc_id").select("doc_id", "quality", "toxic", "text").collect()
    random.Random(0).shuffle(rows)
    return [tuple(r) for r in rows]


def test_toxicity_held_out(labelled):
    model = toxicity.fit([(r[2], r[3]) for r in labelled[:2500]])
    test = labelled[2500:]
    p = model.scores(pa.array([r[3] for r in test])) > 0.5
    y = np.array([r[2] for r in test]) == 1
    assert p[y].mean() >= 0.85 and p[~y].mean() <= 0.03


def test_counterfactual_term_protects_neutral_mentions():
    """Toxic training rows mention one group more often; without the term a neutral mention is flagged."""
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(300)]

    def text(*extra):
        return " ".join(rng.sample([*rng.choices(filler, k=25), *extra], 25 + len(extra)))

    rows = [(1, text(rng.choice(["idiot", "scum"]), "muslim" if rng.random() < 0.8 else "christian")) for _ in range(200)]
    rows += [(1, text("muslim", rng.choice(["rotten", "vile", "foul", "nasty"]))) for _ in range(60)]
    rows += [(0, text(rng.choice(["christian", "teacher", "garden"]))) for _ in range(400)]
    neutral = pa.array([text("muslim") for _ in range(100)] + [text("christian") for _ in range(100)])
    toxic = pa.array([text("idiot") for _ in range(50)])
    with_term, without = toxicity.fit(rows), toxicity.fit(rows, swap=0.0)
    assert (without.scores(neutral)[:100] > 0.5).mean() > 0.9
    assert (with_term.scores(neutral)[:100] > 0.5).mean() < 0.1
    gap = [abs(m.scores(neutral)[:100].mean() - m.scores(neutral)[100:].mean()) for m in (with_term, without)]
    assert gap[0] < 0.2 * gap[1]
    assert (with_term.scores(toxic) > 0.5).mean() > 0.9


def test_swapping():
    assert toxicity.swapped("A Muslim woman, not womanly.") == "A christian man, not womanly."
    assert toxicity.swapped("no group here") == "no group here"


def test_toxicity_messy(spark, messy, empty, labelled):
    model = toxicity.fit([(r[2], r[3]) for r in labelled[:800]])
    got = toxicity.classify(messy, model).collect()
    assert len(got) == messy.count() and not any(r["toxic"] for r in got)
    assert toxicity.classify(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (99, 1), (None, 0), (3, None), (3, 7)], "doc_id long, toxic int")
    blank = toxicity.train(messy, labels)
    assert toxicity.classify(messy, blank).count() == messy.count()
    assert {r["score"] for r in toxicity.classify(messy, toxicity.train(empty, labels)).collect()} == {0.5}


def test_quality_held_out(labelled):
    train = [(r[0], r[1], r[3]) for r in labelled[:2500]]
    model = quality.fit([r for r in train if r[1] == 1][:1500] + [r for r in train if r[1] == 0])
    test = labelled[2500:]
    x = np.concatenate([model.embed(pa.array([r[3] for r in test[i : i + 512]])) for i in range(0, len(test), 512)])
    v = model.vote(pa.array([r[0] for r in test]), x, quality.NEIGHBOURS)
    y = np.array([r[1] for r in test])
    assert (v[y == 1] >= 0.5).mean() >= 0.99 and (v[y == 0] < 0.5).mean() >= 0.8


def test_quality_votes_brute_force(spark, labelled):
    model = quality.fit([(r[0], r[1], r[3]) for r in labelled[:150]])
    docs = labelled[100:220]
    got = {r[0]: r[1] for r in quality.classify(spark.createDataFrame([(r[0], r[3]) for r in docs], "doc_id long, text string").repartition(3), model).collect()}
    for r in docs:
        x = model.embed(pa.array([r[3]]))[0]
        near = sorted((-round(float(x @ v), 5), i, y) for i, v, y in zip(model.ids.to_pylist(), model.vectors, model.labels, strict=True) if i != r[0])[: quality.NEIGHBOURS]
        weight = [max(-c, 0) for c, _, _ in near]
        want = sum(w * y for w, (_, _, y) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got[r[0]] - want) < 2e-3


def test_trigrams_stay_inside_texts():
    texts = ["abc", "", "ab", "xyz1", None, "abcabcabc"]
    together = quality.counts(pa.array(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.counts(pa.array([t, "zzzz"], pa.string()))[0], row)
    assert not together[1].any() and not together[2].any() and together[0].any()


def test_quality_messy(spark, messy, empty, labelled):
    model = quality.fit([(r[0] + 100, r[1], r[3]) for r in labelled[:200]])
    got = {(r["doc_id"], r["quality"] is None, r["keep"]) for r in quality.classify(messy, model).collect()}
    for i in (4, 5, 6, 7, 9):
        assert (i, True, False) in got
    assert (1, False, True) in got
    assert quality.classify(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (99, 1), (None, 0), (9, None), (9, 7)], "doc_id long, quality int")
    assert quality.classify(messy, quality.train(messy, labels)).count() == messy.count()
    assert {r["quality"] for r in quality.classify(messy, quality.train(empty, labels)).collect()} == {None}


def test_quality_and_toxicity_with_named_ids(spark, labelled):
    """Ids that are words give the scores of whole numbers, and a labelled row still doesn't vote for itself."""
    rows = labelled[:160]
    plain = spark.createDataFrame([(r[0], r[3], r[1], r[2]) for r in rows], "doc_id long, text string, quality int, toxic int")
    named = plain.withColumn("doc_id", F.format_string("id-%08d", "doc_id"))
    for train, classify, column in ((quality.train, quality.classify, "quality"), (toxicity.train, toxicity.classify, "score")):
        one, two = (classify(d, train(d, d.select("doc_id", "quality", "toxic"))) for d in (plain, named))
        a, b = ({r["doc_id"]: r[column] for r in x.collect()} for x in (one, two))
        assert {f"id-{i:08d}": s for i, s in a.items()} == b
        mixed = classify(plain, train(plain, plain.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")))
        assert {r["doc_id"]: r[column] for r in mixed.collect()} == a


def test_toxicity_scores_brute_force(spark, messy, labelled):
    """The query's scores from words and beginnings of words, cell by cell in plain Python."""
    import math
    import re

    model = toxicity.fit([(r[2], r[3]) for r in labelled[:800]])
    mask = 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def plain_score(text):
        seen = {}
        for word in re.findall(rb"(?:[0-9a-z]|[\xc3-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2})+", (text or "").lower().encode()):
            total, power, sums = 0, 1, []
            for c in word:
                total = (total + (c + 1) * power) & mask
                power = power * 0x9E3779B97F4A7C15 & mask
                sums.append(total)
            for h in (mix(total), *(mix(sums[p - 1] ^ (0x5851F42D4C957F2D * p & mask)) for p in toxicity.PREFIXES if len(word) > p)):
                seen[h >> (64 - toxicity.BITS)] = seen.get(h >> (64 - toxicity.BITS), 0) + 1
        z = model.intercept + sum(model.weights[c] + (model.weights[c + (1 << toxicity.BITS)] if n > 1 else 0) for c, n in seen.items())
        return 1 / (1 + math.exp(-z))

    docs = [(r[0], r[3]) for r in labelled[800:1000] if re.fullmatch(r"[\x00-\x7f\u00c0-\u024f]*", r[3])]
    assert len(docs) > 100
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), model).collect()}
    assert all(abs(got[i] - plain_score(t)) < 1e-5 for i, t in docs)
    assert len({round(s, 3) for s in got.values()}) >= 10


def test_quality_projection_brute_force(labelled):
    """Latent vectors by an exact decomposition of dense counts: the same subspace, so the same cosines."""
    rows = [(r[0], r[1], r[3]) for r in labelled[:60]]
    model = quality.fit(rows, dimensions=60)
    texts = [r[2] for r in sorted(rows)]
    x = np.concatenate([quality.counts(pa.array([t])) for t in texts])
    scale = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1
    scale[1 << quality.CELL_BITS :] = 1
    _, _, v = np.linalg.svd(x * scale, full_matrices=False)
    z = (x * scale * 1.0) @ v.T
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert np.abs(z @ z.T - model.vectors @ model.vectors.T).max() < 1e-3
