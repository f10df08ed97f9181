"""Queries over whole tables and whole texts, where cuts once were."""

import itertools
import json
import math
import random

from pyspark.sql import functions as F

from sparkfold.operators import cas, columnar, lsh, orchestrate, profile


def items(spark, *data):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in data], "id long, content binary")


def near(rng, base, edits):
    b = bytearray(base)
    for _ in range(edits):
        b[rng.randrange(len(b))] = rng.randrange(256)
    return bytes(b)


def test_every_item_is_searched(spark):
    """Copies, near copies, empty content and null ids, each asked against all others."""
    rng = random.Random(11)
    base, other = rng.randbytes(6000), rng.randbytes(6000)
    data = [(10, base), (20, base), (30, near(rng, base, 8)), (11, other), (12, other), (13, rng.randbytes(6000)), (14, b""), (None, other), (None, rng.randbytes(500))]
    df = items(spark, *data)
    a, b = (x[:, None].astype(object) for x in lsh.coefficients())
    sig = {i: ((a * lsh.reduced_shingles(d).astype(object) + b) % lsh.P).min(1) for i, d in data if i is not None and d}
    want = {(x, y): round(float((sig[x] == sig[y]).mean()), 4) for x, y in itertools.permutations(sig, 2)}
    heads, member = lsh.classes(df)
    of = {r["id"]: r["head"] for r in member.collect()}
    assert of == {10: 10, 20: 10, 30: 30, 11: 11, 12: 11, 13: 13}
    got = {(r["query_id"], r["id"]): (r["jaccard"], r["copies"]) for r in lsh.query_similar(df.where("id <> 13").select("id"), heads, member).collect()}
    asked = {10, 20, 30, 11, 12}
    truth = {}
    for (x, y), j in want.items():
        if x in asked and j >= 0.5:
            truth[x, of[y]] = (j, truth.get((x, of[y]), (0, 0))[1] + 1)
    assert got == truth and got[10, 10] == (1.0, 1) and got[30, 10][1] == 2
    found = sorted(((r["query_id"], r["is_duplicate"]) for r in lsh.duplicates(df).collect()), key=repr)
    truth = [(i, i is not None and any(want.get((i, j), 0) >= 0.95 for j in sig)) for i, _ in data[:7]] + [(None, True), (None, False)]
    assert found == sorted(truth, key=repr) and (10, True) in found and (12, True) in found


def test_matrix_over_all_ids(spark):
    rng = random.Random(12)
    parts = [rng.randbytes(64) for _ in range(9)]
    data = [(i, b"".join(rng.choices(parts, k=rng.randint(0, 4)))) for i in range(30)]
    sets = [{d[i : i + 64] for i in range(0, len(d), 64)} for _, d in data]
    want = {(x, y): 1.0 if x == y else round(len(sets[x] & sets[y]) / len(sets[x] | sets[y]), 6) for x in range(30) for y in range(30) if x == y or sets[x] & sets[y]}
    blocks, member = cas.block_sets(items(spark, *data), 64)
    of = {r["id"]: r["head"] for r in member.collect()}
    assert of == {x: min(y for y in range(30) if sets[y] == sets[x]) for x in range(30) if sets[x]}
    rows = cas.similarity_cells(member.select(F.col("head").alias("id")), cas.jaccard_pairs(blocks)).collect()
    cells = {(r["i"], r["j"]): r["score"] for r in rows}
    assert len(rows) == len(cells) and {(x, y): cells[of[x], of[y]] for x, y in want if x in of} == {p: s for p, s in want.items() if p[0] in of}


def test_signatures_of_long_content_are_whole(spark):
    """Two texts that agree in three pieces only, and one shifted by 4 KiB, all over 1 MiB."""
    rng = random.Random(13)
    third, n = (1 << 20) // 3, 3 << 20
    base = bytearray(rng.randbytes(n))
    other = bytearray(rng.randbytes(n))
    for at in (0, n // 2, n - third):
        other[at : at + third] = base[at : at + third]
    data = [(1, bytes(base)), (2, bytes(other)), (3, bytes(base) + rng.randbytes(4096))]
    a, b = lsh.coefficients()
    shingles = [lsh.reduced_shingles(d) for _, d in data]
    want = [[int(((int(x) * s + int(y)) % lsh.P).min()) for x, y in zip(a, b, strict=True)] for s in shingles]
    df = items(spark, *data)
    assert {r["id"]: r["sig"] for r in lsh.signatures(df).collect()} == dict(zip((1, 2, 3), want, strict=True))
    assert {tuple(sorted((r["a"], r["b"]))) for r in lsh.links(df).collect()} == {(1, 3)}


def test_entropy_of_long_content_is_whole(spark):
    """Zeros for 4 MiB, then every byte equally often."""
    tail = bytes(range(256)) * (1 << 14)
    df = items(spark, (1, bytes(4 << 20) + tail + b"tail"))
    counts = [(4 << 20) + (1 << 14)] + [1 << 14] * 255
    for c in b"tail":
        counts[c] += 1
    n = sum(counts)
    e = -sum(c / n * math.log2(c / n) for c in counts)
    r = profile.entropy_report(df).first()
    assert r["n_bytes"] == n and abs(r["entropy"] - e) < 1e-6
    blocks = [x["entropy"] for x in profile.block_entropies(df, 1 << 16).orderBy("block_index").collect()]
    assert blocks == [0.0] * 64 + [8.0] * 64 + [2.0]
    s = profile.block_entropy_stats(df, 1 << 16).first()
    assert (s["n_blocks"], s["min_e"], s["max_e"]) == (129, 0.0, 8.0) and abs(s["mean_e"] - 514 / 129) < 1e-6
    files = df.select(F.lit("a.txt").alias("path"), "content")
    assert abs(orchestrate.analyse(files).first()["entropy"] - e) < 1e-6


def test_transposition_drops_nothing(spark):
    """A key of few rows, one that first occurs late, one value of another type, and positions from 100 on."""
    docs = [{"id": i, "note": "a"} | ({"user": i} if i % 8 else {}) | ({"late": [1, {"x": None}]} if i > 380 else {}) for i in range(100, 400)]
    docs[7]["id"] = "seven"
    rows = spark.createDataFrame([(100 + n, json.dumps(d)) for n, d in enumerate(docs)], "pos long, json string")
    schema = {r["key"]: r["dominant_type"] for r in columnar.infer_schema(rows, sample=None).where("kept").collect()}
    assert schema == {"id": "int", "note": "str"} and columnar.infer_schema(rows, sample=None).count() == 4
    for kept in (schema, {}):
        got = columnar.to_columns(rows, kept, rest="rest").orderBy("pos").collect()
        back = [{k: r[k] for k in kept if r[k] is not None} | json.loads(r["rest"] or "{}") for r in got]
        assert back == docs and sum(r["bad_values"] for r in got) == bool(kept)
