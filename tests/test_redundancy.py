"""Block storage, similarity, clusters, delta and windows: invariants and the reference's own kinds of cases."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfold.operators import cas, delta, graph, lsh, windows
from sparkfold.plans import redundancy


def items(spark, *data):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id long, content binary")


def test_store_and_reconstruction(spark):
    rng = random.Random(0)
    shared = rng.randbytes(2048)
    df = items(spark, shared, shared, shared + rng.randbytes(700), b"", b"x")
    s = cas.stats(df, 512).first()
    assert s["file_count"] == 5 and s["duplicate_blocks"] == 8 and s["dedup_ratio"] > 1.5 and s["saved_bytes"] == 4096
    store = cas.block_store(df, 512, data=True)
    back = {r["id"]: bytes(r["content"]) for r in cas.reconstruct(cas.recipes(df, 512), store).collect()}
    assert back == {r["id"]: bytes(r["content"]) for r in df.collect() if len(r["content"])}
    part = cas.block_store(df.where("id = 0"), 512, data=True)
    assert {r["id"] for r in cas.missing_blocks(cas.recipes(df, 512), part).collect()} == {2, 4}
    lost = {r["id"]: r["content"] for r in cas.reconstruct(cas.recipes(df, 512), part).collect()}
    assert lost[2] is None and lost[4] is None and bytes(lost[1]) == shared


def test_one_more_copy_adds_one_reference(spark):
    df = items(spark, b"a" * 100, b"b" * 100)
    more = df.unionByName(df.where("id = 0").withColumn("id", F.lit(9).cast("long")))
    refs = {r["hash"]: r["ref_count"] for r in cas.block_store(more, 64).collect()}
    before = {r["hash"]: r["ref_count"] for r in cas.block_store(df, 64).collect()}
    assert sum(refs.values()) == sum(before.values()) + 2 and set(refs) == set(before)
    merged = cas.merge_store(cas.block_store(df, 64), cas.block_store(df.where("id = 0"), 64))
    assert {r["hash"]: r["ref_count"] for r in merged.collect()} == refs


def test_jaccard_brute_force(spark):
    rng = random.Random(2)
    parts = [rng.randbytes(64) for _ in range(12)]
    data = [b"".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(25)]
    data += data[:5]
    sets = [{d[i : i + 64] for i in range(0, len(d), 64)} for d in data]
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in itertools.combinations(range(30), 2) if sets[a] & sets[b]}
    blocks, member = cas.block_sets(items(spark, *data), 64)
    of = {r["id"]: r["head"] for r in member.collect()}
    assert of == {i: min(j for j in range(30) if sets[j] == sets[i]) for i in range(30)}
    got = {(r["a"], r["b"]): (r["inter"], r["uni"]) for r in cas.jaccard_pairs(blocks).collect()}
    assert got == {p: n for p, n in want.items() if of[p[0]] == p[0] and of[p[1]] == p[1]}
    m = {(r["i"], r["j"]): r["score"] for r in cas.similarity_cells(member.select(F.col("head").alias("id")), cas.jaccard_pairs(blocks)).collect()}
    assert all(m[i, j] == m[j, i] for i, j in m) and all(m[i, i] == 1.0 for i in set(of.values()))


def near(rng, base, edits):
    b = bytearray(base)
    for _ in range(edits):
        b[rng.randrange(len(b))] = rng.randrange(256)
    return bytes(b)


def test_similarity(spark):
    rng = random.Random(3)
    base = rng.randbytes(8192)
    data = [near(rng, base, 40) for _ in range(5)] + [rng.randbytes(8192), b"", b"", b"tiny", b"tiny", base, base]
    df = items(spark, *data)
    heads, member = lsh.classes(df)
    pairs = {(r["a"], r["b"]): r["jaccard"] for r in lsh.similar_pairs(heads.select("id", "sig")).collect()}
    of = {r["id"]: r["head"] for r in member.collect()}
    assert of[9] == 8 and of[11] == 10 and 6 not in of and not any({5, 9, 11} & set(p) for p in pairs)
    top = [r["jaccard"] for r in lsh.most_similar(lsh.similar_pairs(heads.select("id", "sig")), 3).collect()]
    assert top == sorted(pairs.values(), reverse=True)[:3]
    truth = {i: set(lsh.reduced_shingles(d).tolist()) for i, d in enumerate(data)}
    for (a, b), j in pairs.items():
        assert abs(j - len(truth[a] & truth[b]) / len(truth[a] | truth[b])) < 0.2
    clustered = {r["id"]: r["cluster_root"] for r in lsh.clusters(lsh.links(df)).collect()}
    assert {clustered[i] for i in (0, 1, 2, 3, 4, 10, 11)} == {0} and clustered[9] == 8 and 5 not in clustered
    with pytest.raises(ValueError):
        lsh.band_table(lsh.signatures(df), 33)
    numbers = [tuple(r) for r in lsh.numbered_clusters(lsh.clusters(lsh.links(df))).orderBy("cluster_id").collect()]
    assert numbers == [(0, 0, 7), (1, 8, 2)]


def test_signatures_are_exact(spark):
    rng = random.Random(4)
    data = rng.randbytes(1001)
    a, b = lsh.coefficients()
    shingles = {int.from_bytes(data[i : i + 8], "little") % lsh.P for i in range(0, len(data) - 7, 4)}
    want = [min((int(x) * v + int(y)) % lsh.P for v in shingles) for x, y in zip(a, b, strict=True)]
    assert lsh.signatures(items(spark, data)).first()["sig"] == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(28)] + [(i, i + 1) for i in range(100, 133)] + [(7, 7)]
    root = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("method", ["zstd_dict", "xor"])
def test_delta_round_trip(spark, method):
    rng = random.Random(5)
    base = rng.randbytes(4096)
    rows = [(base, near(rng, base, 50)), (base, base), (rng.randbytes(4096), rng.randbytes(3000)), (b"", b"abc"), (b"abc", b""), (base, base + b"longer")]
    df = spark.createDataFrame([(i, bytearray(r), bytearray(t)) for i, (r, t) in enumerate(rows)], "id long, r binary, t binary").withColumn("e", delta.encoder(19, method)(F.col("r"), F.col("t")))
    args = ("e.delta", "e.method", "e.reference_hash", "e.target_hash")
    back = df.select("id", "t", "e.ratio", "e.method", delta.decode(F.col("r"), *map(F.col, args), F.octet_length("t").cast("long")).alias("d"), delta.decode(F.lit(b"other"), *map(F.col, args), F.octet_length("t").cast("long")).alias("w")).collect()
    assert all(bytes(r["d"]["content"]) == bytes(r["t"]) and r["d"]["error"] is None and r["method"] == method for r in back)
    assert all("hash mismatch" in r["w"]["error"] and r["w"]["content"] is None for r in back)
    assert next(r for r in back if r["id"] == 1)["ratio"] > 10


def test_reference_is_the_longest(spark):
    df = spark.createDataFrame([(1, "g", bytearray(b"aa")), (2, "g", bytearray(b"bbb")), (3, "g", bytearray(b"ccc")), (4, "h", bytearray(b""))], "id long, grp string, content binary")
    refs = delta.references(df, "grp")
    assert {r["grp"]: (r["reference_id"], r["n_bytes"]) for r in refs.collect()} == {"g": (2, 3), "h": (4, 0)}
    assert sorted(r["id"] for r in delta.with_reference(df, refs, "grp").collect()) == [1, 3]


def test_windows(spark):
    rng = random.Random(6)
    data = [rng.randbytes(10_000), b"X" * 8192, b"", b"q"]
    w = windows.compress(windows.split(items(spark, *data), 4096), 3)
    assert {r["id"]: r["count"] for r in w.groupBy("id").count().collect()} == {0: 3, 1: 2, 3: 1}
    m = windows.manifest(w).orderBy("id", "window_index").collect()
    assert [r["stream_offset"] for r in m if r["id"] == 0] == list(itertools.accumulate([0] + [r["compressed_size"] for r in m if r["id"] == 0][:-1]))
    assert {r["id"]: bytes(r["content"]) for r in windows.restore(w).collect()} == {i: d for i, d in enumerate(data) if d}
    broken = w.withColumn("checksum", F.when(F.col("window_index") == 1, "no").otherwise(F.col("checksum")))
    assert {r["id"]: r["content"] is None for r in windows.restore(broken).collect()} == {0: True, 1: True, 3: False}
    assert {r["id"]: r["content"] is None for r in windows.restore(w.where("id <> 0 OR window_index <> 1")).collect()}[0]
    done = windows.progress(w).where("id = 1").orderBy("window_index").collect()
    assert (done[-1]["done"], done[-1]["total"]) == (2, 2) and done[-1]["ratio"] > 50
    assert windows.seek(w, 2).count() == 1
    with pytest.raises(ValueError):
        windows.seek(w, -1)


def test_manifest_through_json(spark):
    w = windows.manifest(windows.compress(windows.split(items(spark, b"ab" * 5000, b"c"), 4096), codec="run_length"))
    back = windows.manifest_rows(windows.manifest_json(w))
    keep = ("id", "window_index", "original_offset", "original_size", "compressed_size", "stream_offset", "checksum")
    assert sorted(map(tuple, back.select(*keep).collect())) == sorted(map(tuple, w.select(*keep).collect()))
    assert {r[0] for r in back.select("format_version").collect()} == {windows.VERSION}
    with pytest.raises(ValueError):
        windows.packer(codec="delta_run_length")


def test_deltas_are_smaller(spark):
    rng = random.Random(9)
    base = rng.randbytes(20_000)
    rows = [(i, bytearray(base), bytearray(near(rng, base, 100))) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, r binary, t binary").withColumn("e", delta.encoder()(F.col("r"), F.col("t")))
    assert all(r["n"] < 5000 for r in df.select(F.octet_length("e.delta").alias("n")).collect())
    saved = df.select(delta.savings_percent(F.octet_length("t"), F.octet_length("e.delta")).alias("s")).collect()
    assert all(75 < r["s"] < 100 for r in saved)


def test_growing_index(spark, tmp_path):
    """Batches give the pairs and members of the whole, without pairing old items again."""
    from sparkfold.streaming import ingest

    rng = random.Random(10)
    base = "".join(rng.choices("abcdefghij ", k=3000))
    other = "".join(rng.choices("klmnopqrst ", k=3000))
    parts = [[(1, base), (2, other)], [(3, base), (4, base[:2900] + "x" * 100)], [(5, other), (6, other[:2950] + "yy"), (7, "".join(rng.choices("uvwxyz ", k=3000)))]]
    source, out, told = str(tmp_path / "in"), str(tmp_path / "out"), []
    listener = ingest.Progress(lambda *a: told.append(a))
    spark.streams.addListener(listener)
    for part in parts:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_signatures(ingest.content_stream(spark, source, spark.read.parquet(source).schema), out).awaitTermination()
    spark.streams.removeListener(listener)
    whole = spark.createDataFrame([d for p in parts for d in p], "doc_id long, text string").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    heads, member = lsh.classes(whole, "doc_id")
    assert sorted(map(tuple, ingest.read_pairs(spark, out).collect())) == sorted(map(tuple, lsh.similar_pairs(heads.select("id", "sig")).collect()))
    assert {r["id"]: r["head"] for r in ingest.read_members(spark, out).collect()} == {r["id"]: r["head"] for r in member.collect()}
    assert [n for n, _, _ in told] == list(range(1, len(told) + 1))


def test_signatures_of_extreme_numbers_are_exact(spark):
    """Residues at both ends, where one folding of the sum isn't enough, over more than one step."""
    a, b = np.array([1, lsh.P - 1, lsh.P - 1, 2]), np.array([0, lsh.P - 1, 0, lsh.P - 1])
    rng = np.random.default_rng(14)
    words = np.concatenate((np.array([0, 0, lsh.P, 0, lsh.P - 1, 0, 2**32 - 1, 2**32 - 1], "<u4"), rng.integers(0, 2**32, 3 * lsh.STEP, dtype=np.uint32).astype("<u4")))
    for data in (words[:2].tobytes(), words[1:5].tobytes(), words.tobytes()):
        want = [min((int(x) * int(v) + int(y)) % lsh.P for v in lsh.reduced_shingles(data)) for x, y in zip(a, b, strict=True)]
        assert lsh.minima(data, a, b).tolist() == want


def test_packed_bands_are_the_bands(spark):
    """Keys of numbers meet exactly where the keys of text do, for even and odd numbers of slots in a band."""
    rng = random.Random(15)
    sigs = [[rng.choice((0, 1, lsh.P - 1)) for _ in range(12)] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sigs)), "id long, sig array<long>")
    for bands in (2, 4, 6, 12):
        pairs = lambda t: {tuple(r) for r in lsh.candidates(t).collect()}
        assert pairs(lsh.packed_bands(df, bands, 12)) == pairs(lsh.band_table(df, bands, 12)) != set()
    with pytest.raises(ValueError):
        lsh.packed_bands(df, 5, 12)


def test_cluster_stats_of_representatives(spark):
    """Representatives that count for their copies give what all members give, and no signature is made twice."""
    rng = random.Random(16)
    base = rng.randbytes(4096)
    df = items(spark, base, base, near(rng, base, 9), near(rng, base, 9), base, b"tiny", b"tiny", rng.randbytes(4096))
    heads, member = lsh.classes(df)
    clustered = lsh.clusters(lsh.linked(heads, member))
    light = lsh.cluster_stats(clustered, heads)
    assert sorted(map(tuple, light.collect())) == sorted(map(tuple, lsh.cluster_stats(clustered, lsh.signatures(df)).collect()))
    assert "Python" not in light._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in light._jdf.queryExecution().executedPlan().toString()


def test_batches_are_small(spark, sf_dir):
    """Queries and operators bound the bytes of a batch, so Python's memory doesn't follow the length of texts."""
    from sparkfold.functions.lineage import BATCH_BYTES, spread
    from sparkfold.plans.common import contents

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for use in (lambda: contents(spark, sf_dir), lambda: spread(spark.range(3).toDF("id"))):
        spark.conf.unset(key)
        use()
        assert int(spark.conf.get(key)) == BATCH_BYTES
    long = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("t"))
    sizes = long.mapInArrow(lambda bs: (b.select(["id"]).slice(0, 1).set_column(0, "id", [b.num_rows]) for b in bs), "id long").collect()
    assert len(sizes) > 4 and max(r["id"] for r in sizes) < 100


def test_minima_work_on_flat_arrays():
    """One product of two arrays of one length for each step, filled up; fewer shingles than a step, a step and more give exact minima."""
    a, b = lsh.coefficients(5)
    for n in (2, 63, 64, 65, 66, lsh.STEP, lsh.STEP + 1, lsh.STEP + 2, 3 * lsh.STEP):
        data = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32).astype("<u4").tobytes()
        x = lsh.reduced_shingles(data).tolist()
        assert lsh.minima(data, a, b).tolist() == [min((int(i) * v + int(j)) % lsh.P for v in x) for i, j in zip(a, b, strict=True)]
    flat = lsh._repeated(a.astype(np.uint64).tobytes(), lsh.FILL)
    assert flat.shape == (5 * lsh.FILL,) and flat[lsh.FILL :: lsh.FILL].tolist() == a[1:].tolist()


def test_candidates_are_joined_by_numbers(spark):
    """No struct is sorted: the numbers of a key come first."""
    data = [(i, [i % 3, 5, 2**31 - 2, i % 2] * 3) for i in range(12)]
    df = lsh.packed_bands(spark.createDataFrame(data, "id long, sig array<long>"), 3, 12)
    plan = lsh.candidates(df)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.split("\n") if "Sort [" in line]
    assert sorts and all("Sort [_k0" in line and "key" not in line for line in sorts)
    assert {tuple(r) for r in lsh.candidates(df).collect()} == {(i, j) for i in range(12) for j in range(i + 1, 12) if i % 6 == j % 6}


def test_classes_hash_signatures_in_the_worker(spark):
    """Equal signatures have one key, which comes with them out of one Python pass."""
    df = spark.createDataFrame([(1, bytearray(b"abcdefgh" * 9)), (2, bytearray(b"abcdefgh" * 9)), (3, bytearray(b"other text of its own")), (4, bytearray(b"")), (5, None)], "id long, content binary")
    keyed = lsh.keyed_signatures(df)
    assert keyed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r["id"]: r for r in keyed.collect()}
    assert set(rows) == {1, 2, 3} and rows[1]["k"] == rows[2]["k"] != rows[3]["k"] and rows[1]["sig"] == rows[2]["sig"]
    assert bytes(rows[3]["k"]) == hashlib.sha256(np.array(rows[3]["sig"], np.int64).tobytes()).digest()
    heads, member = lsh.classes(df)
    assert {r["id"]: r["copies"] for r in heads.collect()} == {1: 2, 3: 1} and {tuple(r) for r in member.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_bands_of_duplicates_have_numbers(spark, monkeypatch):
    """32 rows a signature are joined: their ids are numbers, not hashes."""
    seen = []
    real = lsh.similar_pairs
    monkeypatch.setattr(lsh, "similar_pairs", lambda heads, *a: seen.append(heads.schema["id"].dataType.simpleString()) or real(heads, *a))
    text = np.random.default_rng(3).bytes(9000)
    rows = [(1, bytearray(text)), (1, bytearray(text)), (None, bytearray(text[:-4])), (4, bytearray(b"something else")), (5, bytearray(b"")), (6, None)]
    found = lsh.duplicates(spark.createDataFrame(rows, "id long, content binary"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, True), (1, True), (None, True), (4, False), (5, False), (6, False)], key=str) and seen == ["bigint"]


def test_first_of_equal_texts_without_moving_texts(spark):
    rows = [(1, b"a"), (2, b"a"), (3, b"b"), (3, b"a"), (None, b"c"), (5, b"d"), (5, b"e"), (6, b"e")]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "doc_id long, content binary")
    found = redundancy._first_of_equal(df)
    assert sorted((r["doc_id"], bytes(r["content"])) for r in found.collect()) == [(1, b"a"), (3, b"a"), (3, b"b"), (5, b"d"), (5, b"e")]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_texts_of_clusters_are_found_without_moving_all(spark, sf_dir):
    found = redundancy._grouped(spark, sf_dir)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    own = {r["doc_id"]: r["cluster_root"] for r in redundancy.lsh_clusters(spark, sf_dir).collect()}
    assert own and {r["doc_id"]: r["cluster_root"] for r in found.collect()} == own
