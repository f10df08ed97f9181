"""Queries that write files and read them through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.functions.lineage import shared_folder
from sparkfold.operators import formats, grid, images
from sparkfold.sources import files

from .common import query, table, values
from .media import _PX, _image_files


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query("SELECT 'd' || page_id % 3 || '/p' || page_id || '.html' AS name, octet_length(encode(html)) AS size, sha256(unhex(substr(hex(encode(html)), 1, 512))) AS header_hash, sha256(encode(html)) AS content_hash FROM pages WHERE length(html) > 0")
def source_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of one of three folders: what the file source and its headers give."""
    folder = _folder(spark, "files")
    name = F.format_string("d%d/p%d.html", F.col("page_id") % 3, F.col("page_id"))
    files.write(table(spark, sf_dir, "pages").select(name.alias("name"), C.utf8(F.col("html")).alias("content")), folder)
    found = files.binary(spark, folder, "*.html")
    heads = files.headers(found).select("path", F.sha2("header", 256).alias("header_hash"))
    both = found.select("path", "size", F.sha2("content", 256).alias("content_hash")).join(heads, "path")
    return both.select(F.regexp_extract("path", "(d[0-9]/p[0-9]+[.]html)$", 1).alias("name"), "size", "header_hash", "content_hash")


@query("SELECT event_id, event_type, value, user_id FROM events")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "csv")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id").write.csv(folder, header=True)
    return files.csv_rows(spark, folder, "event_id long, event_type string, value double, user_id long")


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS pos, event_id, event_type FROM events")
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a file with an array of objects."""
    folder = _folder(spark, "json")
    one = F.struct("event_id", "user_id", "event_type")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("j"))
    files.write(rows.select(F.format_string("u%d.json", "user_id").alias("name"), C.utf8(F.col("j")).alias("content")), folder)
    v = files.json_rows(spark, folder)
    return v.select(F.get_json_object("json", "$.user_id").cast("long").alias("user_id"), "pos", F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), F.get_json_object("json", "$.event_type").alias("event_type"))


@query("SELECT event_id, event_type FROM events")
def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON."""
    folder = _folder(spark, "lines")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(folder)
    v = files.json_rows(spark, folder, lines=True)
    return v.select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), F.get_json_object("json", "$.event_type").alias("event_type"))


@query(f"SELECT img_id, x, y, r, g, b FROM {_PX}")
def source_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as PNG files through Spark's image source."""
    folder = _folder(spark, "images")
    files.write(_image_files(spark).select(F.format_string("i%d.png", "img_id").alias("name"), "content"), folder)
    px = images.pixels(files.images(spark, folder))
    return px.withColumn("img_id", F.regexp_extract("img_id", "i([0-9])[.]png$", 1).cast("int"))


@query("SELECT 'd' || doc_id AS file_name, octet_length(encode(text)) AS file_size, 'run_length' AS strategy, round(octet_length(encode(text)) / 7.0::DOUBLE, 6) AS ratio, true AS lossless_verified FROM documents")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV and read again."""
    folder = _folder(spark, "report")
    docs = table(spark, sf_dir, "documents")
    n = C.size_of(C.utf8(F.col("text")))
    grid.write_report(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_name"), n.alias("file_size"), F.lit("run_length").alias("strategy"), F.round(n / 7.0, 6).alias("ratio"), F.lit(True).alias("lossless_verified")), folder)
    back = files.csv_rows(spark, folder)
    return back.select("file_name", F.col("file_size").cast("long").alias("file_size"), "strategy", F.col("ratio").cast("double").alias("ratio"), F.col("lossless_verified").cast("boolean").alias("lossless_verified"))


_MADE = [("text_small.txt", 10_000, "TXT"), ("text_medium.txt", 100_000, "TXT"), ("text_large.txt", 1_000_000, "TXT"), ("log_medium.json", 199_988, "JSON"), ("log_large.json", 999_988, "JSON"), ("low_entropy.bin", 500_000, "UNKNOWN"), ("high_entropy.bin", 500_000, "UNKNOWN"), ("gradient_512.png", -1, "PNG"), ("solid_256.png", -1, "PNG"), ("report.docx", -1, "DOCX")]


@query(f"SELECT path, CASE WHEN path LIKE '%.json' THEN -1 ELSE size END AS size, type FROM {values(_MADE, 'path, size, type')}")
def generated_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated files; sizes of those that a library or a count of items decides are -1."""
    from sparkfold.sources import archives

    made = files.collection(spark).withColumns({"header": C.slice_of(F.col("content"), 0, 256), "members": archives.member_names(F.col("content"))})
    found = formats.detect(made, members="members")
    free = F.col("path").rlike("[.](json|png|docx)$")
    return found.select("path", F.when(free, -1).otherwise(C.size_of(F.col("content"))).alias("size"), "type")
