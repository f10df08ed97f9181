"""The pipeline against its stages run by hand, and its contract."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from test_packing_mixing import naive_mix

from sparkfold.llm import exact_dedup, langid, minhash, packing
from sparkfold.llm.frames import table


def test_stages_keep_the_contract(spark, sf_dir):
    docs = first = table(spark, sf_dir, "documents")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen.append(docs)
        if len(seen) < len(corpus_pipeline.STAGES):
            assert docs.columns == first.columns
            docs = spark.createDataFrame(docs.collect(), first.schema)
    # language: every document of a known language stays
    known, kept = langid.identify(first, langid.train(first)).where("keep"), seen[0]
    assert kept.count() == known.count()
    # exact copies: one of each text
    texts = [r[0] for r in seen[1].select("text").collect()]
    assert len(texts) == len(set(texts)) == seen[0].select("text").distinct().count()
    # near copies: one of each group
    groups = minhash.groups(seen[1])
    assert seen[2].count() == groups.select("group_id").distinct().count()
    # mixing: as many as before; packing: every token
    assert seen[3].count() == seen[2].count()
    tokens = sum(len(re.findall(r"\S+", r[0])) for r in seen[3].select("text").collect())
    assert seen[4].agg({"tokens": "sum"}).first()[0] == tokens


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and len({r["bin_id"] for r in got}) == len(got)
    assert all(len(re.findall(r"\S+", r["text"])) == r["tokens"] for r in got)


def test_odd_columns_and_null_ids(spark):
    """Columns that a DDL string can't name, and null ids, through all stages."""
    texts = ["the quick brown fox jumps over the lazy dog and runs away", "der schnelle braune Fuchs springt über den faulen Hund", "中文 是 一种 语言 我们 今天 去 学校"]
    rows = [(n if n % 4 else None, texts[n % 3] + f" {'abcdefgh'[n % 8] * 5}", ("en", "de", "zh")[n % 3], f"s{n % 2}", n, "x", 2.0, True, "k") for n in range(24)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "a.b", "x y", "q:z", "a-b", "b`t"])
    for d in (docs, docs.limit(0)):
        now = d
        for _, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, "")
            if "sequences" not in stage.__name__:
                assert now.columns == docs.columns and (now.count() > 0) == (before.count() > 0)
            now = spark.createDataFrame(now.collect(), now.schema)
        assert (now.count() > 0) == (d is docs)


# The five stages once more, in plain Python and without their modules.


def plain_words(text):
    return re.findall(r"[0-9a-zà-öø-ÿß]+", text.lower())


def plain_language(docs):
    """The documents of which the trained languages explain half of the words; all rows are training rows here."""
    cells, alpha, penalty = 1 << 16, 0.05, 18.0

    def trigrams(word):
        b = [32, *word.encode(), 32]
        return [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False)]

    langs = sorted({d["lang"] for d in docs if d["lang"] and d["text"]})
    counts = {x: Counter(c for d in docs if d["lang"] == x and d["text"] for w in plain_words(d["text"]) for c in trigrams(w)) for x in langs}
    total = {x: sum(counts[x].values()) + alpha * cells for x in langs}

    def score(word, lang):
        return sum(math.log((counts[lang][c] + alpha) / total[lang]) for c in trigrams(word))

    def keep(text):
        words = [w for w in plain_words(text or "") if not w.isdigit()]
        if not words:
            return False
        best, paths = [score(words[0], x) for x in langs], [[i] for i in range(len(langs))]
        for w in words[1:]:
            top = max(range(len(langs)), key=lambda i: best[i])
            came = [i if best[i] >= best[top] - penalty else top for i in range(len(langs))]
            best = [max(best[i], best[top] - penalty) + score(w, x) for i, x in enumerate(langs)]
            paths = [[*paths[came[i]], i] for i in range(len(langs))]
        path = paths[max(range(len(langs)), key=lambda i: best[i])]
        known = sum(any(counts[langs[i]][c] for c in trigrams(w)) for w, i in zip(words, path, strict=True))
        return known >= 0.5 * len(words)

    return [d for d in docs if keep(d["text"])]


def plain_exact(docs):
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first.setdefault(d["text"], d)
    return list(first.values())


def plain_near(docs):
    """Components of pairs by true Jaccard; the fixture has no pair near the threshold."""
    def shingles(text):
        w = plain_words(text)
        return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))}

    docs = sorted(docs, key=lambda d: d["doc_id"])
    sets, root = [shingles(d["text"]) for d in docs], list(range(len(docs)))
    for b in range(len(docs)):
        for a in range(b):
            share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert not 0.3 < share < 0.7, "the fixture must be clear"
            if share >= 0.5:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return [d for n, d in enumerate(docs) if root[n] == n]


def plain_packing(docs, capacity):
    """Best-fit decreasing over all pieces: {(doc_ids, pieces, starts, text): how often}."""
    pieces = []
    for d in docs:
        words = re.findall(r"\S+", d["text"])
        pieces += [(-len(words[p * capacity : (p + 1) * capacity]), d["doc_id"], p, d["text"]) for p in range(-(-len(words) // capacity))]
    bins, clock = [], 0
    for size, i, p, t in sorted(pieces, key=lambda x: x[:3]):
        fits = [b for b in bins if b["room"] >= -size]
        if fits:
            b = min(fits, key=lambda b: (b["room"], -b["since"]))
        else:
            b = {"room": capacity, "items": []}
            bins.append(b)
        b["items"].append((i, p, capacity - b["room"], t))
        b["room"] += size
        clock += 1
        b["since"] = clock
    return Counter((tuple(x[0] for x in b["items"]), tuple(x[1] for x in b["items"]), tuple(x[2] for x in b["items"]), capacity - b["room"]) for b in bins)


def test_run_brute_force(spark, sf_dir):
    """run()'s rows against the plain versions above, on documents with copies, near copies, noise, nulls and several sources."""
    rng = random.Random(11)
    base = [r.asDict() for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    base = plain_exact([d for d in base if re.fullmatch(r"[\x00-\x7fà-öø-ÿÀ-ÖØ-ß]*", d["text"]) and len(plain_words(d["text"])) >= 30])
    shapes = [set(zip(w, w[1:], w[2:], strict=False)) for w in (plain_words(d["text"]) for d in base)]
    base = [d for n, d in enumerate(base) if all(len(shapes[n] & s) / len(shapes[n] | s) < 0.25 for s in shapes[:n])][:50]
    docs, n = [], 0
    for d in base:
        n += 7
        docs.append(d | {"doc_id": n, "source": f"s{n % 5 // 2}"})
    docs += [d | {"doc_id": 1000 + i, "source": "s1"} for i, d in enumerate(docs[:12])]
    for i, d in enumerate(docs[12:24]):
        words = d["text"].split(" ")
        words[rng.randrange(len(words))] = "zzz"
        docs.append(d | {"doc_id": 2000 + i, "text": " ".join(words)})
    docs += [docs[0] | {"doc_id": 3000 + i, "lang": None, "text": " ".join("".join(rng.choices("qxzjkvwy", k=9)) for _ in range(50))} for i in range(5)]
    docs += [docs[0] | {"doc_id": 4000 + i, "text": t} for i, t in enumerate((None, "", "17 2024 ..."))]
    docs = [d | {"n_chars": len(d["text"] or "")} for d in docs]
    rng.shuffle(docs)
    kept = plain_language(docs)
    assert {d["doc_id"] for d in docs} - {d["doc_id"] for d in kept} == {*range(3000, 3005), 4000, 4001, 4002}
    one = plain_near(plain_exact(kept))
    assert len(one) == len(base)
    drawn = naive_mix([(d["doc_id"], d["text"], d["source"]) for d in one])
    mixed = [{"doc_id": i, "text": t} for (i, _, t), c in drawn.items() for _ in range(c)]
    want = plain_packing(mixed, packing.CAPACITY)
    got = corpus_pipeline.staged(spark, spark.createDataFrame(docs, table(spark, sf_dir, "documents").schema), sf_dir).collect()
    assert Counter((tuple(r["doc_ids"]), tuple(r["pieces"]), tuple(r["starts"]), r["tokens"]) for r in got) == want
    assert all(r["text"] == packing.SEPARATOR.join(piece_of(mixed, i, p) for i, p in zip(r["doc_ids"], r["pieces"], strict=True)) for r in got)


def piece_of(docs, doc_id, piece):
    text = next(d["text"] for d in docs if d["doc_id"] == doc_id)
    at = [m.span() for m in re.finditer(r"\S+", text)][piece * packing.CAPACITY : (piece + 1) * packing.CAPACITY]
    return text[at[0][0] : at[-1][1]]


def test_messy_documents(spark, messy, empty):
    for docs in (messy, empty):
        now = docs.select("doc_id", "text", "lang", "source")
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            now = spark.createDataFrame(now.collect(), now.schema)
        assert (now.count() > 0) == (docs is messy)
    assert exact_dedup.dedup(messy).count() == 11
