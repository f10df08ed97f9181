"""Exact dedup and near-dedup against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkfold.llm import exact_dedup, minhash
from sparkfold.llm.frames import table


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def by_text(docs):
    found = {}
    for i, t in docs:
        found.setdefault(t, []).append(i)
    return found


def test_exact_groups_messy(messy):
    got = rows(exact_dedup.groups(messy), "doc_id", "kept_id", "copies", "keep")
    fox = ((1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False))
    for r in fox:
        assert r in got
    assert (4, 4, 1, True) in got and (5, 5, 1, True) in got  # null texts aren't copies
    assert (6, 6, 2, True) in got and (7, 6, 2, False) in got  # empty ones are
    assert got.count((11, 11, 2, True)) == 2  # repeated rows
    assert len(got) == messy.count()


def test_exact_dedup_messy(messy, empty):
    kept = exact_dedup.dedup(messy)
    assert kept.columns == messy.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13]
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.groups(empty).count() == 0


def test_exact_collisions(messy):
    """With a hash that is the same for all, only the byte comparison parts texts."""
    same = exact_dedup.groups(messy, hash_fn=lambda t: F.unhex(F.md5(F.substring(t, 1, 0))))
    assert rows(same, "doc_id", "kept_id", "copies", "keep") == rows(exact_dedup.groups(messy), "doc_id", "kept_id", "copies", "keep")
    kept = exact_dedup.dedup(messy, hash_fn=lambda t: F.unhex(F.md5(F.substring(t, 1, 0))))
    assert rows(kept, "doc_id") == rows(exact_dedup.dedup(messy), "doc_id")


def test_exact_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = by_text(rows(docs, "doc_id", "text"))
    got = rows(exact_dedup.groups(docs), "doc_id", "kept_id", "copies", "keep")
    assert got == sorted(((i, min(ids), len(ids), i == min(ids)) for ids in want.values() for i in ids), key=repr)


def naive_signature(elements, m):
    """SuperMinHash slot by slot, for one text."""
    best = [2**64 - 1] * m
    for x in set(elements):
        perm = list(range(m))
        for j in range(m):
            z = int(minhash.mix(np.array([(x + 0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
            k = j + (((z & 0xFFFFFFFF) * (m - j)) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            best[perm[j]] = min(best[perm[j]], (j << 32) | (z >> 32))
    return best


def test_superminhash_slot_by_slot(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 300)]
    x, ptr = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    got = minhash.superminhash(x, ptr, 32)
    for s, row in zip(sets, got, strict=True):
        assert row.tolist() == naive_signature(s.tolist(), 32)
    for most in (1, 10, 45):  # in parts
        monkeypatch.setattr(minhash, "MOST", most)
        assert (minhash.superminhash(x, ptr, 32) == got).all()


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (int(300 * share), int(150 * (1 - share)), int(150 * (1 - share))))
            x = np.concatenate((both, a, both, b))
            sig = minhash.superminhash(x, np.array([0, len(both) + len(a), len(x)]))
            errors.append((sig[0] == sig[1]).mean() - len(both) / (len(both) + len(a) + len(b)))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def elements(text):
    x, ptr = minhash.shingles(pa.array([text]))
    return set(x[ptr[0] : ptr[1]].tolist())


def test_near_brute_force(spark, sf_dir):
    """All pairs by true Jaccard: recall of at least 0.95 a bit above the threshold, and nothing joined far below it."""
    docs = table(spark, sf_dir, "documents")
    sets = {i: elements(t) for i, t in rows(docs, "doc_id", "text")}
    group = {i: g for i, g in rows(minhash.groups(docs), "doc_id", "group_id")}
    score = {(a, b): len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) for a, b in itertools.combinations(sorted(sets), 2)}
    near = [p for p, s in score.items() if s >= minhash.THRESHOLD + 0.1]
    assert near and sum(group[a] == group[b] for a, b in near) >= 0.95 * len(near)
    link = {i: i for i in sets}
    for _ in range(20):
        for (a, b), s in score.items():
            if s >= minhash.THRESHOLD - 0.15:
                link[a] = link[b] = min(link[a], link[b])
    assert all(link[i] == link[g] for i, g in group.items())


def test_near_messy(messy, empty):
    got = rows(minhash.groups(messy), "doc_id", "group_id", "keep")
    assert (1, 1, True) in got and (2, 1, False) in got and (None, None, True) in got
    for i in (4, 5, 6, 7, 8, 9, 10):
        assert (i, i, True) in got
    kept = minhash.dedup(messy)
    assert kept.columns == messy.columns
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11, 12, 13]
    assert minhash.dedup(empty).count() == 0 and minhash.groups(empty).count() == 0


def test_near_many_copies(spark):
    """Groups of hundreds of copies and of edited copies come out whole."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs, want = [], {}
    for g in range(3):
        base = [rng.choice(words) for _ in range(200)]
        for c in range(150):
            text = list(base)
            for _ in range(c % 3):
                text[rng.randrange(200)] = rng.choice(words)
            docs.append((g * 1000 + c, " ".join(text)))
            want[g * 1000 + c] = g * 1000
    got = dict(rows(minhash.groups(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "group_id"))
    assert sum(got[i] == w for i, w in want.items()) >= 0.99 * len(want)


def brute_groups(docs):
    """Components over all pairs of signatures that share a band and agree enough, in plain Python."""
    rows = [(i, t) for i, t in docs if t and i is not None]
    out = pa.Table.from_batches(minhash._signed(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "text"])])))
    ids, bands, slots = out.column("id").to_pylist(), out.column("bands").to_pylist(), [np.frombuffer(b, np.uint8) for b in out.column("slots").to_pylist()]
    keys = list(zip(out.column("k0").to_pylist(), out.column("k1").to_pylist(), strict=True))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in itertools.combinations(range(len(ids)), 2):
        near = keys[x] == keys[y] or set(bands[x]) & set(bands[y]) and ((slots[x] == slots[y]).mean() - 1 / 256) / (1 - 1 / 256) >= minhash.THRESHOLD
        if near and find(ids[x]) != find(ids[y]):
            a, b = sorted((find(ids[x]), find(ids[y])))
            root[b] = a
    return {i: find(i) for i in ids}


def boilerplate(families, members, shared, own, seed=5):
    """Texts of ``shared`` common words in runs, family words and own ones: alike across families to a degree below the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(20_000)]
    common = [rng.choice(words) for _ in range(shared)]
    docs = []
    for f in range(families):
        body = [rng.choice(words) for _ in range(200 - shared - own)]
        for m in range(members):
            docs.append((f * 1000 + m, " ".join(common + body + [rng.choice(words) for _ in range(own)])))
    return docs


def test_near_equals_all_pairs(spark):
    """Texts that share boilerplate fall into one bucket without being alike; groups are those of all pairs."""
    docs = boilerplate(60, 4, 85, 20) + boilerplate(1, 60, 85, 25, seed=6) + boilerplate(150, 1, 95, 105, seed=7)
    docs = [(n, t) for n, (_, t) in enumerate(docs)]
    got = dict(rows(minhash.groups(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "group_id"))
    assert got == brute_groups(docs)


def test_boilerplate_pairs_stay_few(spark):
    """Thousands of unlike texts with a common passage: the last step forms far fewer pairs than the bucket has, and loses none that passes."""
    docs = boilerplate(3000, 1, 60, 140)
    signed = minhash.signatures(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("r", F.col("id"))
    assert signed.select(F.explode("bands").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] > 20
    assert minhash.across(signed).count() < 20 * len(docs)
    assert len(set(dict(rows(minhash.groups(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "group_id")).values())) == len(docs)


def test_across_finds_every_pair_that_passes(spark):
    docs = boilerplate(20, 6, 60, 40) + boilerplate(30, 1, 100, 100)
    docs = [(n, t) for n, (_, t) in enumerate(docs)]
    signed = minhash.signatures(spark.createDataFrame(docs, "doc_id long, text string"))
    slots = {r["id"]: np.frombuffer(r["slots"], np.uint8) for r in signed.collect()}
    for group in (lambda i: i, lambda i: i % 7, lambda i: i % 2):
        got = {tuple(r) for r in minhash.across(signed.withColumn("r", F.udf(group, "long")("id"))).collect()}
        want = {(a, b) for b, a in itertools.combinations(sorted(slots), 2) if (slots[a] == slots[b]).sum() >= 97 and group(a) != group(b)}
        assert want and want <= got and all(group(a) != group(b) for a, b in got)


def test_ids_of_other_kinds(spark):
    """Words and numbers as ids, and one id with several texts, give the groups of whole numbers."""
    docs = boilerplate(8, 5, 60, 30)
    want = dict(rows(minhash.groups(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "group_id"))
    assert len(set(want.values())) == 8
    name = "id-{:08d}-x".format
    named = spark.createDataFrame([(name(i), t) for i, t in docs] + [(None, docs[0][1])], "doc_id string, text string")
    assert dict(rows(minhash.groups(named), "doc_id", "group_id")) == {name(i): name(g) for i, g in want.items()} | {None: None}
    assert sorted(r[0] or "" for r in minhash.dedup(named).select("doc_id").collect()) == ["", *sorted({name(g) for g in want.values()})]
    decimal = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("CAST(doc_id AS DECIMAL(12, 2)) AS doc_id", "text")
    assert {int(a): int(b) for a, b in rows(minhash.groups(decimal), "doc_id", "group_id")} == want
    twice = spark.createDataFrame([*docs, (0, docs[-1][1])], "doc_id int, text string")  # one id, texts of the first and the last group
    got = dict(rows(minhash.groups(twice), "doc_id", "group_id"))
    last = want[docs[-1][0]]
    assert got == {i: 0 if g == last else g for i, g in want.items()}


def test_odd_column_names(spark):
    docs = boilerplate(3, 3, 60, 30)
    odd = spark.createDataFrame([(i, t, 1, "x", 2.0, True, "k") for i, t in docs], ["doc_id", "text", "a.b", "x y", "q:z", "a-b", "b`t"])
    for kept in (minhash.dedup(odd), exact_dedup.dedup(odd)):
        assert kept.columns == odd.columns and kept.count() in (3, 9)
