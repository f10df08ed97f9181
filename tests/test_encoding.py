"""Columnar encodings, containers, archives, images and streams."""

import io
import lzma
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfold.operators import codecs, columnar, images, residuals
from sparkfold.sources import archives, container, files
from sparkfold.streaming import ingest


def rows(spark, *json):
    return spark.createDataFrame(list(enumerate(json)), "pos long, json string")


def test_schema_inference(spark):
    df = rows(spark, *[f'{{"id": {i}, "name": "n{i}", "f": {i}.5, "ok": true, "o": {{"x": 1}}}}' for i in range(100)])
    got = {r["key"]: (r["n_present"], r["dominant_type"], r["kept"]) for r in columnar.infer_schema(df).collect()}
    assert got == {"id": (100, "int", True), "name": (100, "str", True), "f": (100, "float", True), "ok": (100, "bool", True), "o": (100, "str", True)}
    mixed = rows(spark, *['{"a": 1}'] * 5, *['{"b": null}'] * 5)
    found = columnar.infer_schema(mixed)
    assert {r["key"]: (r["dominant_type"], r["kept"]) for r in found.collect()} == {"a": ("int", False), "b": ("int", False)}
    assert not columnar.uniformity(found).first()["is_uniform"]
    assert not columnar.uniformity(columnar.infer_schema(rows(spark).limit(0))).first()["is_uniform"]


def test_typed_columns_keep_nulls(spark):
    df = rows(spark, '{"id": 1, "note": null}', '{"id": "x", "note": "b"}', '{"note": ""}')
    got = columnar.to_columns(df, {"id": "int", "note": "str"}).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 1, None, 0), (1, None, "b", 1), (2, None, "", 0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_over_partitions(spark, parts):
    rng = random.Random(parts)
    data = [(i * 3, rng.randrange(-(10**12), 10**12)) for i in range(500)]
    df = spark.createDataFrame(data, "pos long, v long").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    d = columnar.int_delta(df, "v", "pos").orderBy("pos").collect()
    assert [r["d"] for r in d] == [data[0][1]] + [b[1] - a[1] for a, b in zip(data, data[1:], strict=False)]
    back = columnar.with_running_sum(spark.createDataFrame(d).drop("v"), "d", "pos", "v")
    assert sorted((r["pos"], r["v"]) for r in back.collect()) == data
    assert [r["k"] for r in columnar.with_position(df, "pos", "k").orderBy("pos").collect()] == list(range(500))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def naive_varint(v):
    z = (v << 1) ^ (v >> 63) if v >= 0 else (-v << 1) - 1
    out = bytearray()
    while True:
        out.append((z & 127) | (128 if z >> 7 else 0))
        z >>= 7
        if not z:
            return bytes(out)


def test_varints(spark):
    rng = random.Random(8)
    v = [0, 1, -1, 63, 64, -64, -65, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**k), 2**k) for k in range(1, 63)]
    df = spark.createDataFrame([(x,) for x in v], "v long").select("v", columnar.zigzag(F.col("v")).alias("z"))
    got = df.select("v", columnar.unzigzag(F.col("z")).alias("u"), columnar.varint_length(F.col("z")).alias("n"), columnar.varint_hex(F.col("z")).alias("h")).collect()
    for r in got:
        want = naive_varint(r["v"])
        assert r["u"] == r["v"] and r["h"] == want.hex().upper() and r["n"] == len(want)
    whole = b"".join(map(naive_varint, v))
    back = spark.createDataFrame([(bytearray(whole),), (bytearray(whole[:-1] + b"\x80"),), (bytearray(b""),)], "b binary").select(columnar.varint_decode("b").alias("v")).collect()
    assert [r["v"] for r in back] == [v, None, []]


def test_dictionary_and_bits(spark):
    data = [(i, x) for i, x in enumerate(["b", None, "a", "b", "c", None, "a"])]
    df = spark.createDataFrame(data, "pos long, v string")
    assert {r["value"]: r["code"] for r in columnar.dictionary(df, "v", "pos").collect()} == {"b": 0, None: 1, "a": 2, "c": 3}
    assert sorted((r["pos"], r["value"], r["code"]) for r in columnar.dict_encode(df, "v", "pos").collect()) == [(i, x, {"b": 0, None: 1, "a": 2, "c": 3}[x]) for i, x in data]
    flags = [bool(i * 7 % 3) for i in range(29)]
    packed = columnar.bit_pack(spark.createDataFrame(list(enumerate(flags)), "pos long, f boolean"), F.col("f"))
    assert [r["flag"] for r in columnar.bit_unpack(packed).orderBy("pos").collect()][:29] == flags


def test_container_source(spark, tmp_path):
    spark.dataSource.register(container.Container)
    df = spark.createDataFrame([(f"f{i}", i * 10, "traditional_zstd", {"k": "v"}, bytearray(b"p" * i)) for i in range(20)], "name string, original_size long, strategy string, metadata map<string,string>, payload binary")
    df.repartition(3).write.format("container").mode("append").save(str(tmp_path))
    back = spark.read.format("container").load(str(tmp_path))
    assert sorted((r["name"], r["original_size"], bytes(r["payload"]), r["metadata"]["k"], r["error"]) for r in back.collect()) == sorted((f"f{i}", i * 10, b"p" * i, "v", None) for i in range(20))
    good = container.pack(b"payload", 99, "s")
    for bad in (b"", b"NOPE" + good[4:], good[:-1], good[:4] + b"\x09" + good[5:], good[:-1] + b"?"):
        assert not container.validate(bad)
        (tmp_path / "bad.fold").write_bytes(bad)
        assert spark.read.format("container").load(str(tmp_path)).where("error IS NOT NULL").count() == 1
    manifest, body = container.unpack_stream(container.pack_stream([b"ab", b"c"], {"windows": 2}))
    assert manifest == {"windows": 2} and body == b"abc"
    with pytest.raises(container.FormatError):
        container.unpack_stream(b"x")


def office():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "<w/>")
        z.writestr("word/media/i.PNG", b"\x89PNG")
        z.writestr("empty.bin", b"")
    return b.getvalue()


def pdf():
    text = zlib.compress(b"BT (Hello \\(World\\)) Tj [(a) 3 (b)] TJ ET")
    return b"%PDF-1.4\n1 0 obj <</Type /Pages /Kids [2 0 R 3 0 R]>> endobj\n2 0 obj <</Type /Page /MediaBox [0 0 612 792]>> endobj\n3 0 obj <</Type /Page>> endobj\n4 0 obj <</Filter /FlateDecode>> stream\n" + text + b"\nendstream endobj\n5 0 obj <</Type /Font /BaseFont /Helvetica>> endobj\n"


def test_archives(spark):
    df = spark.createDataFrame([(1, bytearray(office())), (2, bytearray(b"no zip")), (3, None)], "id long, content binary")
    got = [(r["id"], r["path"], r["type"]) for r in archives.zip_components(df).collect() if r["error"] is None]
    assert got == [(1, "[Content_Types].xml", "xml"), (1, "word/document.xml", "xml"), (1, "word/media/i.PNG", "media"), (1, "empty.bin", "other")]
    assert archives.zip_components(df).where("error IS NOT NULL").count() == 2
    found = archives.pdf_components(spark.createDataFrame([(1, bytearray(pdf())), (2, bytearray(b"x"))], "id long, content binary")).collect()
    assert [(r["type"], bytes(r["data"])) for r in found if r["id"] == 1] == [("metadata", b"1.4"), ("layout", b"612x792"), ("layout", b"612x792"), ("text", b"Hello (World) ab"), ("font", b"Helvetica")]
    assert [r["error"] for r in found if r["id"] == 2] == ["not a PDF"]


def png(pixels):
    """A height x width x 3 array as PNG."""
    h, w, _ = pixels.shape

    def chunk(kind, data):
        body = kind + data
        return len(data).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big")

    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in pixels.astype(np.uint8)))) + chunk(b"IEND", b"")


def test_image_source(spark, tmp_path):
    ramp = np.zeros((40, 60, 3))
    ramp[:, :, 0], ramp[:, :, 1] = np.rint(np.linspace(0, 255, 60)), 100
    noise = np.random.default_rng(0).integers(0, 256, (40, 60, 3))
    (tmp_path / "ramp.png").write_bytes(png(ramp))
    (tmp_path / "noise.png").write_bytes(png(noise))
    px = images.pixels(files.images(spark, str(tmp_path)))
    one = px.where("img_id LIKE '%noise.png' AND x = 7 AND y = 3").first()
    assert (one["r"], one["g"], one["b"]) == tuple(noise[3, 7])
    assert {r["img_id"].rsplit("/", 1)[1]: (r["direction"], r["is_gradient"]) for r in images.linear_gradients(px).collect()} == {"ramp.png": ("horizontal", True), "noise.png": (None, False)}
    made = images.classify(images.features(px).withColumns({"has_transparency": F.lit(False), "is_grayscale": F.lit(False)}))
    assert {r["img_id"].rsplit("/", 1)[1]: r["content_type"] for r in made.collect()}["ramp.png"] == "gradient"
    dot = spark.createDataFrame([("d", 0, 0, 1, 2, 3)], "img_id string, x int, y int, r int, g int, b int")
    f = images.features(dot).first()
    assert f["edge_density"] == 0.0 and f["horizontal_stripe_score"] == 0.0 and f["palette_size"] == 1


def test_residuals_make_it_lossless():
    image = np.random.default_rng(1).integers(0, 256, (16, 20, 3)).astype(np.uint8)
    compress, decompress = residuals.lossless(lambda a: (a // 32).astype(np.uint8).tobytes(), lambda b: (np.frombuffer(b, np.uint8) * 32).reshape(16, 20, 3))
    assert (decompress(*compress(image)) == image).all()
    assert (residuals.from_tensor(residuals.to_tensor(image)) == image).all() and residuals.to_tensor(image).shape == (1, 3, 16, 20)
    assert residuals.applies("medical", 0.61, "medical") and not residuals.applies("medical", 0.6, "medical")


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from sparkfold.operators import cas

    docs = [[(i, f"text {i % 7} " * 30) for i in range(lo, lo + 20)] for lo in (0, 20)]
    source = str(tmp_path / "in")
    for part in docs:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        stream = ingest.content_stream(spark, source, spark.read.parquet(source).schema)
        ingest.ingest_blocks(stream, str(tmp_path / "out"), 64).awaitTermination()
    got = {(r["hash"], r["size"], r["ref_count"]) for r in ingest.read_store(spark, str(tmp_path / "out")).collect()}
    whole = spark.createDataFrame([d for part in docs for d in part], "doc_id long, text string").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    assert got == {(r["hash"], r["size"], r["ref_count"]) for r in cas.block_store(whole, 64, "doc_id").collect()}


def test_lzma_of_a_short_text_needs_little_memory(spark):
    """The dictionary of the preset takes 8 MiB, and time to clear, for each text; the stream stays one that any reader takes."""
    text = b"a short text, " * 20
    packed = codecs.codec("traditional_lzma").compress(text)
    assert lzma.LZMADecompressor(memlimit=1 << 20).decompress(packed) == text == lzma.decompress(packed)
    assert len(packed) <= len(lzma.compress(text, preset=6))
    long = bytes(range(256)) * 50_000
    assert lzma.decompress(codecs.codec("traditional_lzma").compress(long)) == long


def test_many_containers_make_few_tasks(tmp_path, monkeypatch):
    """Files a task grow with the files, a given number counts, and a batch is bounded by bytes."""
    for i in range(10):
        (tmp_path / f"n{i}.fold").write_bytes(container.pack(bytes(1000), 1000, "plain", {"k": str(i)}))
    (tmp_path / "n3.fold").write_bytes(b"none")
    monkeypatch.setattr(container, "FEWEST", 1)
    monkeypatch.setattr(container, "TASKS", 3)
    monkeypatch.setattr(container, "BATCH_BYTES", 2000)
    parts = container._Reader({"path": str(tmp_path)}).partitions()
    assert [len(p.paths) for p in parts] == [4, 4, 2]
    given = container._Reader({"path": str(tmp_path), "filesPerTask": "5"})
    assert [len(p.paths) for p in given.partitions()] == [5, 5]
    batches = list(given.read(given.partitions()[0]))
    assert [b.num_rows for b in batches] == [2, 3]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["name"] for r in rows] == [f"n{i}" for i in range(5)] and rows[3]["error"] == "no container" and dict(rows[4]["metadata"])["k"] == "4"


def test_best_of_keeps_one_payload_a_row(spark):
    """As the ranking of all attempts has it, with each codec run once and no shuffle of payloads."""
    from sparkfold.operators import selection

    texts = ["", "a" * 600, "abcdefgh" * 30, "".join(chr(97 + i % 26) for i in range(500)), "x"]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)] + [(9, None)], "id long, content binary")
    names = ("run_length", "delta_run_length", "semantic_json")
    best = codecs.best_of(df, names)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Aggregate" not in plan
    got = {r["file_id"]: (r["strategy"], r["ratio"]) for r in best.collect()}
    want = {r["file_id"]: (r["strategy"], r["ratio"]) for r in selection.best_attempt(codecs.attempts(df.where("content IS NOT NULL"), names, excellent=1e9), 1e9).collect()}
    assert got == want | {9: (None, None)}
    back = {r["file_id"]: bytes(r["b"]) for r in best.where("strategy IS NOT NULL").select("file_id", codecs.restored("packed", "strategy").alias("b")).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts)}
