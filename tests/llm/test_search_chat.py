"""Top-k search and chat repair against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.llm import chat, topk


def brute(ids, x, k):
    out = []
    for i, a in zip(ids, x, strict=True):
        found = sorted((-round(float(np.cumsum(a * b)[-1]), 9), j) for j, b in zip(ids, x, strict=True) if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(spark, ids, x, k, block):
    df = spark.createDataFrame([(int(i), [float(v) for v in e]) for i, e in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    return sorted(map(tuple, topk.search(df, k, block=block).collect()))


@pytest.mark.parametrize("kind", ["random", "clustered", "signed", "ties"])
def test_topk_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    if kind == "clustered":
        x = rng.normal(size=(8, 12))[rng.integers(0, 8, 400)] * 4 + 0.1 * x
    if kind == "signed":
        x *= np.geomspace(1, 1e-3, 12)
    if kind == "ties":
        x = np.round(x[rng.integers(0, 30, 400)])
    ids = rng.permutation(5000)[:400]
    want = brute(ids.tolist(), x, 7)
    for block in (64, 1000):
        assert run(spark, ids, x, 7, block) == want


def test_bound_holds_and_stops_early():
    """The bound covers every unseen vector, and in few dimensions only a part is seen."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    order, ends, high, low = topk.arrange(x)
    y, norm = x[order], float(np.linalg.norm(x, axis=1).max())
    q = x[:50]
    for t in range(len(high)):
        bound = topk.unseen_bound(q, high[t], low[t], norm)
        assert (bound + 1e-9 >= (q @ y[ends[t] :].T).max(1)).all()
    best = topk.Best(np.arange(50) + 10**6, q, 5)
    best.search(np.arange(3000), y, ends, high, low, norm, False)
    assert best.seen < 0.3 * 50 * 3000


def test_topk_messy(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [2.0]), (8, [float("inf"), 0.0]), (1, [0.0, 1.0])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS q", "2 AS block", "3 AS score")
    got = sorted(map(tuple, topk.search(df, 3).collect()))
    assert [r for r in got if r[0] == 7] == [(7, 1, 1, 2.0), (7, 2, 2, 1.0), (7, 3, 1, 0.0)]
    assert {r[0] for r in got} == {1, 2, 7} and not any(r[0] == r[2] for r in got)
    assert topk.search(df.limit(0), 3).count() == 0
    assert topk.search(df.where("vec_id = 2"), 3).count() == 0


def test_promises_hold():
    """No vector of a block scores more than its summary promises."""
    rng = np.random.default_rng(9)
    for scale in (1.0, 1e-3, 1e4):
        y = scale * (rng.normal(size=(50, 6)) + rng.normal(size=6) * 3)
        x = rng.normal(size=(40, 6))
        summary = (y.mean(0)[None], np.array([topk.norms(y - y.mean(0)).max()]), y.min(0)[None], y.max(0)[None], np.array([topk.norms(y).max()]))
        assert (topk.promise(x, topk.norms(x), *summary)[:, 0] >= (x @ y.T).max(1) - 1e-9 * scale).all()


def test_topk_stated_queries_and_named_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    ids = np.arange(300)
    want = [r for r in brute(ids.tolist(), x, 4) if r[0] % 50 == 0]
    df = spark.createDataFrame([(int(i), e.tolist()) for i, e in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, 4, block=40, queries=df["vec_id"] % 50 == 0).collect())) == want
    named = df.selectExpr("format_string('v-%06d', vec_id) AS vec_id", "embedding")
    got = topk.search(named, 4, block=40, queries=F.substring("vec_id", 3, 6).cast("int") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == [(f"v-{i:06d}", r, f"v-{j:06d}", s) for i, r, j, s in want]
    assert topk.search(df, 4, queries=F.lit(False)).count() == 0


def test_topk_is_exact_in_hard_cases(spark):
    """Near ties in 1024 dimensions, outliers of huge norm, products beyond single precision, and one very long vector."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=1024)
    x = base + 1e-4 * rng.normal(size=(150, 1024))
    assert run(spark, np.arange(150), x, 5, 64) == brute(list(range(150)), x, 5)
    y = rng.normal(size=(200, 16))
    y[:30] *= 1e5
    got, want = run(spark, np.arange(200), y, 5, 64), brute(list(range(200)), y, 5)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-14)
    z = rng.normal(size=(120, 16))
    z[:20] *= 1e30
    got = run(spark, np.arange(120), z, 5, 32)
    for i in range(120):
        scores = sorted((-(float(np.cumsum(z[i] * z[j])[-1])), j) for j in range(120) if j != i)[:5]
        assert [r[2] for r in got if r[0] == i] == [j for _, j in scores]
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(y)] + [(1000, [0.5] * 300_000)], "vec_id long, embedding array<double>")
    long = topk.search(df, 3, block=64).collect()
    assert sorted(tuple(r) for r in long if r[0] == 1000)[0][2] == int(y.sum(1).argmax())
    assert len(long) == 3 * 201


def test_topk_reads_few_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64)) * 3
    x = centres[rng.integers(0, 40, 8000)] + 0.3 * rng.normal(size=(8000, 64))
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "id long, v array<double>").withColumn("asks", F.col("id") % 50 == 0)
    placed, widths = topk._placed(df, 128)
    made = placed.groupBy("block").applyInArrow(topk._block(widths), topk._BLOCKED).cache()
    asked = placed.where("asks").withColumn("qblock", F.col("block")).groupBy("qblock").applyInArrow(topk._queries(widths), "q long, q_width int, q_ids binary, q_vectors binary").cache()
    score = x @ x[::50].T
    np.put_along_axis(score, np.arange(0, 8000, 50)[None], -np.inf, 0)
    kth = dict(zip(range(0, 8000, 50), np.sort(score, axis=0)[-5], strict=True))
    floors = {r["q"]: np.array([kth[i] for i in np.frombuffer(r["q_ids"], np.int64).tolist()]).tobytes() for r in asked.collect()}
    table = spark.createDataFrame([(q, bytearray(f)) for q, f in floors.items()], "q long, floor binary")
    assert topk.block_pairs(asked.join(table, "q"), made, None).count() < made.count() * asked.count() / 3


def cheapest(roles):
    """The least cost over all assignments of roles."""
    best = None
    for p in itertools.product(range(3), repeat=len(roles)):
        cost = sum(0 if r == chat.ROLES[s] else (chat.TO_SYSTEM if s == 2 else chat.RELABEL) for r, s in zip(roles, p, strict=True))
        cost += int(chat.START[p[0]] + chat.END[p[-1]] + sum(chat.STEP[a, b] for a, b in itertools.pairwise(p)))
        best = cost if best is None else min(best, cost)
    return best


def legal(text):
    roles = [x.split("|>")[0] for x in text.split("<|") if not x.startswith("end|>") and x]
    body = roles[1:] if roles[0] == "system" else roles
    return body and body == ["user", "assistant"] * (len(body) // 2)


def test_repair_is_cheapest(spark):
    rng = random.Random(4)
    rows, roles = [], {}
    for c in range(150):
        roles[c] = [rng.choice(["user", "assistant", "system", "tool", None]) for _ in range(rng.randint(1, 6))]
        rows += [(c, i, r, f"t{i}") for i, r in enumerate(roles[c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    for c, r in got.items():
        assert r["cost"] == cheapest(roles[c])
        assert legal(r["text"]), r["text"]
        assert r["text"].count("<|end|>") == r["turns_out"] == r["turns_in"] - r["merges"] + r["inserts"]
        at = [r["text"].index(f"t{i}") for i in range(len(roles[c]))]
        assert at == sorted(at)
    assert len(got) == 150


def test_chat_messy(spark):
    long = "z" * 200_000
    rows = [
        (1, 1, "user", "hi"), (1, 2, "user", "again"), (1, 3, "assistant", None),
        (2, 1, None, ""), (2, None, "Assistant ", "<|user|> no"), (2, 1, None, ""),
        (3, 1, "system", long), (None, 1, "user", "nobody's"), (4, 1, "assistant", "only"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS cost")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["text"] == "<|user|>\nhi\nagain<|end|>\n<|assistant|>\n<|end|>\n"
    assert got[2]["text"] == "<|user|>\n<|end|>\n<|assistant|>\n< |user|> no<|end|>\n" and got[2]["turns_in"] == 2
    assert got[4]["text"] == "<|user|>\n<|end|>\n<|assistant|>\nonly<|end|>\n" and got[4]["inserts"] == 1
    assert long in got[3]["text"] and set(got) == {1, 2, 3, 4}
    assert chat.format_chats(df.limit(0)).count() == 0
