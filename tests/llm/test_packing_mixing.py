"""Packing, sharding and mixing: round trips, bounds and brute force."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfold.llm import mixing, packing, sharding
from sparkfold.llm.frames import table


def least_bins(sizes, capacity):
    """The true optimum of a small case, by search over partitions."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                place(i + 1, bins)
                bins[b] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def plain_best_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(capacity - s)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_and_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 31, 9)
    best = least_bins(sizes.tolist(), 30)
    where, offset, bins = packing.best_fit_decreasing(sizes, 30)
    assert packing.lower_bound(sizes, 30) <= best <= bins == plain_best_fit(sizes.tolist(), 30)
    for b in range(bins):
        inside = sorted(zip(offset[where == b], sizes[where == b], strict=True))
        assert inside[0][0] == 0 and all(a + n == c for (a, n), (c, _) in itertools.pairwise(inside)) and sum(n for _, n in inside) <= 30


def check_packing(got, docs, capacity):
    """Every token of every row exactly once, bins within capacity, the certificate true."""
    tokens = {}
    for i, t in docs:
        tokens.setdefault(i, []).append(len(re.findall(r"\S+", t or "")))
    packed = {}
    for r in got:
        packed.setdefault(r["doc_id"], []).append(r["tokens"])
    assert {i: sum(n) for i, n in packed.items()} == {i: sum(n) for i, n in tokens.items()}
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append((r["start"], r["tokens"]))
    for inside in bins.values():
        inside.sort()
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(inside)) and inside[-1][0] + inside[-1][1] <= capacity
    assert all(r["certified"] == (r["part_bins"] == r["part_bound"]) for r in got if r["bin_id"] is not None)
    parts = {r["bin_id"] >> 32: r["part_bins"] for r in got if r["bin_id"] is not None}
    assert sum(parts.values()) == len(bins)


def test_pack_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = packing.pack(docs, capacity=256, per_partition=100, rounds=3).collect()
    check_packing(got, [tuple(r) for r in docs.select("doc_id", "text").collect()], 256)


def test_sequences(spark, sf_dir, messy, empty):
    """Every token of every row is in the sequences, in its place, with the white space of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    extra = [(10**6, "twice  the\tsame\n\ntext"), (10**6, "twice  the\tsame\n\ntext"), (10**6, "one id, another text"), (None, "no id"), (None, None), (10**6 + 1, " \n "), (10**6 + 2, "w " * 700 + "end")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = packing.sequences(docs, capacity=256, per_partition=60).collect()
    texts = {}
    for i, t in docs.collect():
        texts.setdefault(i, []).append(t)
    from collections import Counter

    pieces = Counter()
    for r in got:
        assert len(re.findall(r"\S+", r["text"])) == r["tokens"] <= 256
        if r["bin_id"] is None:
            assert r["tokens"] == 0 and r["text"] == ""
            continue
        words = re.findall(r"\S+", r["text"])
        for i, p, at, to in zip(r["doc_ids"], r["pieces"], r["starts"], [*r["starts"][1:], len(words)], strict=True):
            pieces[i, p, " ".join(words[at:to])] += 1
        assert any(t and r["text"].split(packing.SEPARATOR)[0] in t for t in texts[r["doc_ids"][0]])
    want = Counter()
    for i, ts in texts.items():
        for t in ts:
            words = re.findall(r"\S+", t or "")
            for p, at in enumerate(range(0, len(words), 256)):
                want[i, p, " ".join(words[at : at + 256])] += 1
    assert pieces == want
    assert len({r["bin_id"] for r in got if r["bin_id"] is not None}) == sum(r["bin_id"] is not None for r in got)
    assert sum(r["bin_id"] is None for r in got) == 2
    assert sum(r["tokens"] for r in packing.sequences(messy, capacity=1000).collect()) == sum(len(re.findall(r"\S+", r["text"] or "")) for r in messy.collect())
    assert packing.sequences(empty).count() == 0


def test_exchange_saves_bins(spark):
    """Partitions with a gap need fewer bins together, every item stays packed once, and no bin overflows."""
    saved = []
    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(20, 60, 600)
        items = spark.createDataFrame([(i, b"", 0, int(n)) for i, n in enumerate(sizes)], "id long, hash binary, piece int, size int")
        found = {}
        for rounds in (0, 3):
            rows = packing.packed(items, 100, 60, rounds).collect()
            assert sorted((r["id"], r["size"]) for r in rows) == list(enumerate(sizes.tolist()))
            used = {}
            for r in rows:
                used[r["part"], r["bin"]] = used.get((r["part"], r["bin"]), 0) + r["size"]
            assert max(used.values()) <= 100 and len(used) >= packing.lower_bound(sizes, 100)
            assert len(used) == sum({r["part"]: r["bins"] for r in rows}.values())
            found[rounds] = len(used)
        assert found[3] <= found[0]
        saved.append(found[0] - found[3])
    assert sum(saved) > 0, saved


def test_pack_messy(messy, empty):
    got = packing.pack(messy, capacity=1000).collect()
    check_packing(got, [tuple(r) for r in messy.select("doc_id", "text").collect()], 1000)
    assert sum(r["doc_id"] == 10 for r in got) == 60
    assert [(r["tokens"], r["bin_id"]) for r in got if r["doc_id"] == 4] == [(0, None)]
    assert packing.pack(empty).count() == 0


def naive_shards(rows, limit):
    """Split bucket by bucket."""
    done, todo = {}, [("", rows)]
    while todo:
        prefix, inside = todo.pop()
        if sum(b for _, b in inside) <= limit or len(prefix) == 60:
            for h, _ in inside:
                done.setdefault(h, prefix)
            continue
        for bit in "01":
            deeper = [(h, b) for h, b in inside if h[len(prefix)] == bit]
            if deeper:
                todo.append((prefix + bit, deeper))
    return done


@pytest.mark.parametrize("limit", [2_000, 50_000, 10**9])
def test_sharding_brute_force(spark, sf_dir, limit):
    import hashlib

    docs = table(spark, sf_dir, "documents")
    bits = {}
    rows = []
    for i, t in docs.select("doc_id", "text").collect():
        bits[i] = format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b")
        rows.append((bits[i], len(t.encode())))
    want = naive_shards(rows, limit)
    got = sharding.assign(docs, limit).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == {i: want[b] for i, b in bits.items()}
    assert all(r["shard_bytes"] <= limit or r["oversized"] for r in got)


def test_sharding_messy(messy, empty):
    got = sharding.assign(messy, 100).collect()
    assert len(got) == messy.count()
    assert [r["oversized"] for r in got if r["doc_id"] == 10] == [True]
    assert len({r["shard"] for r in got if r["doc_id"] == 11}) == 1
    assert sum(r["bytes"] for r in got if r["doc_id"] in (4, 5, 6, 7)) == 0
    assert sharding.assign(empty, 100).count() == 0


def test_mixing_sizes_and_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r[0]: r[1] for r in mixing.sample(docs, {"src0": 3, "src1": 1}, size=40, carry=False).groupBy("source").agg(F.sum("copies")).collect()}
    assert got == {"src0": 30, "src1": 10}
    mixed = mixing.sample(docs)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()


def test_mixing_is_proportional_to_measure(spark):
    """Over many seeds-worth of ids, inclusion follows the measure: fixed size, unequal probabilities."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), 998)).otherwise("xxxxxx").alias("text"), F.lit("s").alias("source"))
    got = mixing.sample(docs, size=5000, carry=False)
    even = got.where("doc_id % 2 = 0").count()
    g = round(1000 * np.log(1000)), round(1000 * np.log(8))
    assert got.count() == 5000 and abs(even / 5000 - g[0] / sum(g)) < 0.02


def test_mixing_messy(messy, empty):
    got = mixing.sample(messy)
    assert got.columns == messy.columns and got.count() == messy.count()
    assert mixing.sample(messy, {}).count() == 0 and mixing.sample(messy, {"nobody": 1.0}).count() == 0
    assert mixing.sample(messy, {"d": 1.0}, size=7).select("source").distinct().collect() == [("d",)]
    assert mixing.sample(messy, {"d": 1.0}, size=7).count() == 7
    assert mixing.sample(empty).count() == 0 and mixing.sample(empty, carry=False).count() == 0


def naive_mix(docs, size=None):
    """{(id, source, text): copies} of rows (id, text, source) by square-root shares, row by row."""
    import hashlib
    import math
    from collections import Counter, defaultdict
    from decimal import ROUND_HALF_UP, Decimal

    seen, units, n = Counter(), defaultdict(list), Counter(s for _, _, s in docs)
    for i, t, s in docs:
        m = hashlib.md5((t or "").encode()).hexdigest()
        j = seen[s, i, m]
        seen[s, i, m] += 1
        g = int(Decimal(1000 * math.log(2 + len(t or ""))).quantize(Decimal(1), ROUND_HALF_UP))
        key = f"{mixing.SEED}|{'' if i is None else i}|{m}" + (f"|{j}" if j else "")
        units[s].append((i, t, m, j, g, (int(hashlib.md5(key.encode()).hexdigest()[:15], 16) + 0.5) / 2**60))
    total, w = size or len(docs), {s: math.sqrt(c) for s, c in n.items()}
    quota = {s: round(round(x / sum(w.values()), 12) * total, 6) for s, x in w.items()}
    target = {s: math.floor(q) for s, q in quota.items()}
    for s in sorted(quota, key=lambda s: (-round(quota[s] - target[s], 6), s is None, s or ""))[: total - sum(target.values())]:
        target[s] += 1
    out = Counter()
    for s, us in units.items():
        g_all, rank = sum(u[4] for u in us), []
        for i, t, m, j, g, u in us:
            sure, p = target[s] * g // g_all, target[s] * g % g_all / g_all
            out[i, s, t] += sure
            if p:
                rank.append((u / (1 - u) / (p / (1 - p)), str(i if i is not None else ""), m, j, i, t))
        for _, _, _, _, i, t in sorted(rank)[: target[s] - sum(target[s] * u[4] // g_all for u in us)]:
            out[i, s, t] += 1
    return +out


def test_mixing_brute_force(spark):
    """Nulls, repeated rows and a source of one repeated row, against the draw row by row; both forms agree."""
    rng = np.random.default_rng(3)
    docs = [(int(i), "x" * int(n), ["a", "b", "c", None][i % 4]) for i, n in enumerate(rng.integers(0, 400, 300))]
    docs += [(7, "same", "b")] * 40 + [(None, "nobody", "a")] * 3 + [(8, None, "c"), (8, "", "c"), (1, "", "d")] + [(900, "alone", "e")] * 60
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for size in (None, 50, 4000):
        want = naive_mix(docs, size)
        assert sum(want.values()) == (size or len(docs))
        light = [(r["doc_id"], r["source"], r["copies"]) for r in mixing.sample(table, size=size, carry=False).collect()]
        assert sorted(light, key=repr) == sorted(((i, s, c) for (i, s, _), c in merged(want).items()), key=repr)
        full = mixing.sample(table, size=size).groupBy("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).count().collect()
        assert {(r[0], r[1], r[2]): r[3] for r in full} == {k: c for k, c in merged(want).items()}


def merged(want):
    """A null and an empty text are one document."""
    out = {}
    for (i, s, t), c in want.items():
        out[i, s, t or ""] = out.get((i, s, t or ""), 0) + c
    return out


def test_mixing_keeps_its_size_with_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text", "a")] * 50 + [(2, "other text", "b")] * 50, "doc_id long, text string, source string")
    got = mixing.sample(docs, size=10).groupBy("source").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 5, "b": 5}
    many = mixing.sample(docs, {"a": 1.0}, size=10_000)  # more copies than a task makes at a time
    assert many.count() == 10_000 and many.distinct().count() == 1
    assert mixing.sample(docs, {"a": 1.0, "absent": 3.0}, size=8).count() == 8
