"""Profiles, formats, selection and content expressions on seeded bytes and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.operators import codecs, formats, grid, profile, selection
from sparkfold.sources import files


def items(spark, *data):
    return spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "id long, content binary")


def naive_entropy(b):
    return -sum(b.count(x) / len(b) * math.log2(b.count(x) / len(b)) for x in set(b)) if b else 0.0


def test_entropy_report(spark):
    rng = random.Random(0)
    data = [b"", b"aaaa", b"abab", bytes(range(256)), rng.randbytes(65536), b"Hello World. " * 100, None]
    got = {r["id"]: r for r in profile.entropy_report(items(spark, *data)).collect()}
    for i, d in enumerate(data[:-1]):
        assert abs(got[i]["entropy"] - naive_entropy(d)) < 1e-6
    assert got[0]["est_ratio"] == got[1]["est_ratio"] == 100.0 and got[3]["est_ratio"] == 1.0
    assert got[4]["is_random"] and got[4]["entropy"] > 7.5 and not got[5]["is_random"] and 2 < got[5]["entropy"] < 7
    assert got[5]["label"] == "Good" and got[1]["label"] == "Excellent" and got[4]["label"] == "Poor"
    assert got[6]["entropy"] is None


def test_blocks_and_samples(spark):
    data = bytes(range(256)) * 17 + b"tail"
    df = items(spark, data, b"", b"xy")
    got = profile.block_entropies(df, 1000).orderBy("id", "block_index").collect()
    want = [naive_entropy(data[i : i + 1000]) for i in range(0, len(data), 1000)]
    assert [r["entropy"] for r in got if r["id"] == 0] == pytest.approx(want, abs=1e-6) and not [r for r in got if r["id"] == 1]
    stats = {r["id"]: r for r in profile.block_entropy_stats(df, 1000).collect()}
    assert stats[0]["n_blocks"] == len(want) and stats[1]["n_blocks"] == 0 and stats[1]["min_e"] is None
    s = {r[0]: bytes(r[1]) for r in df.select("id", C.three_point_sample(F.col("content"), 300)).collect()}
    n = len(data)
    assert s[0] == data[:100] + data[n // 2 : n // 2 + 100] + data[-100:] and s[2] == b"xy"


def test_format_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.bin").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 20)
    (tmp_path / "c.json").write_text("[]")
    found = formats.detect(files.headers(files.binary(spark, str(tmp_path))))
    got = {r["path"].rsplit("/", 1)[1]: (r["type"], r["confidence"]) for r in found.collect()}
    assert got == {"a.txt": ("TXT", 0.6), "b.bin": ("PNG", 0.95), "c.json": ("JSON", 0.6)}


def report(spark, **given):
    base = {"file_id": 1, "format_type": "TXT", "mime_type": "text/plain", "category": "text", "size": 1 << 20, "entropy": 5.0, "est_ratio": 2.0, "content_type": None, "content_confidence": None, "generation": None, "generation_confidence": None}
    kinds = "file_id long, format_type string, mime_type string, category string, size long, entropy double, est_ratio double, content_type string, content_confidence double, generation string, generation_confidence double"
    return spark.createDataFrame([tuple((base | given).values())], kinds)


def test_selection(spark):
    order = [tuple(r) for r in selection.ranked(report(spark)).select("strategy", "priority").collect()]
    assert order == [("traditional_zstd", 50)]
    json = selection.ranked(report(spark, format_type="JSON")).orderBy("rank").collect()
    assert [r["strategy"] for r in json] == ["semantic_json", "traditional_zstd"] and json[0]["est_ratio"] == 80.0
    none = selection.ranked(report(spark, format_type="DWG"), []).collect()
    assert [(r["strategy"], r["priority"]) for r in none] == [("traditional_zstd", 999)]
    both = spark.createDataFrame([(1, "traditional_lzma"), (1, "traditional_zstd")], "file_id long, strategy string")
    assert selection.within_memory(both, 50).count() == 1 and selection.within_memory(both, 1024).count() == 2


def test_best_attempt_stops_at_excellent(spark):
    rows = [(1, "a", 0, 1000, 500, True, None), (1, "b", 1, 1000, 10, True, None), (1, "c", 2, 1000, 5, True, None), (2, "a", 0, 9, 3, True, None), (2, "b", 1, 9, 3, True, None), (2, "c", 2, 9, 1, False, None), (2, "d", 3, 9, 1, True, "x"), (3, "a", 0, 9, 0, True, None), (4, "a", 0, 9, 1, False, None)]
    df = spark.createDataFrame(rows, "file_id long, strategy string, ord int, original_size long, compressed_size long, lossless boolean, error string")
    assert {r["file_id"]: (r["strategy"], r["ratio"]) for r in selection.best_attempt(df).collect()} == {1: ("b", 100.0), 2: ("a", 3.0), 3: ("a", 0.0)}


def test_codecs_round_trip(spark):
    rng = random.Random(1)
    df = items(spark, b"", b"x", b"abc" * 10_000, rng.randbytes(5000))
    for name in ("traditional_zstd", "traditional_lzma"):
        assert all(r["lossless"] for r in codecs.roundtrip(df, name).collect())
    tries = codecs.attempts(df, ["traditional_zstd", "traditional_lzma"]).collect()
    assert {r["ord"] for r in tries if r["file_id"] == 2} == {0}  # the first is excellent
    assert {r["ord"] for r in tries if r["file_id"] == 3} == {0, 1} and all(r["lossless"] for r in tries)
    if codecs.brotli is None:
        failed = codecs.attempts(df, ["traditional_brotli"]).collect()
        assert all("not installed" in r["error"] and not r["lossless"] for r in failed)
    with pytest.raises(KeyError):
        codecs.codec("nothing")
    with pytest.raises(ValueError):
        codecs.with_levels(lzma_preset=10)


def test_registered_codec_is_used(spark):
    codecs.register_codec(codecs.Codec("reversed", lambda b: b[::-1], lambda b: b[::-1], "1.0D"))
    try:
        assert codecs.roundtrip(items(spark, b"abc"), "reversed").first()["lossless"]
    finally:
        del codecs.CODECS["reversed"]


def test_reports(spark, tmp_path):
    rows = [(1, "a", 2.0, 1.0, 1.0, True, None), (1, "b", 3.0, 1.0, 1.0, True, None), (1, "c", 9.0, 1.0, 1.0, True, "x"), (2, "b", 2.0, 1.0, 1.0, False, None)]
    df = spark.createDataFrame(rows, "file_id long, strategy string, ratio double, compression_ms double, decompression_ms double, lossless boolean, error string")
    assert {r["file_id"]: r["strategy"] for r in grid.best_per_file(df).collect()} == {1: "b", 2: "b"}
    assert {r["strategy"]: (r["records"], r["avg_ratio"], r["all_lossless"]) for r in grid.strategy_summary(df).collect()} == {"a": (1, 2.0, True), "b": (2, 2.5, False)}
    assert [r["strategy"] for r in grid.ranking(df).collect()] == ["b", "a"]
    grid.write_report(df, str(tmp_path / "r"))
    head = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()[0]
    assert head == ",".join(grid.REPORT_COLUMNS)
    with pytest.raises(ValueError):
        grid.write_report(df, str(tmp_path / "x"), "pdf")


@pytest.mark.parametrize("kind", ["text", "json", "low_entropy", "high_entropy"])
def test_generated_content(spark, kind):
    made = files.patterned(spark, 3, 4096, kind)
    e = [r["entropy"] for r in profile.entropy_report(made).collect()]
    assert (min(e) > 7.5) if kind == "high_entropy" else (max(e) < 6)
    assert made.collect() == files.patterned(spark, 3, 4096, kind).collect()
