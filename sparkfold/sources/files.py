"""Files and tables as rows of content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions import content as C
from sparkfold.operators import gradients, raster

from . import archives, container


def binary(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, modified, content) of files. Spark's file scan leaves out files of zero bytes, so they have no row."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    return read.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def write(rows: DataFrame, folder: str) -> None:
    """Rows (name, content) as files of a folder that all executors share, by the tasks themselves; a task that runs again writes the same files."""

    def put(part) -> None:
        store, base = container.opened(folder)
        for r in part:
            path = f"{base}/{container.safe(r['name'])}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as f:
                f.write(bytes(r["content"]))

    rows.select("name", "content").foreachPartition(put)


def headers(files: DataFrame, limit: int = 256) -> DataFrame:
    """Files with their first bytes only; content is dropped early."""
    return files.withColumn("header", C.slice_of(F.col("content"), 0, limit)).drop("content")


def in_memory(spark: SparkSession, items: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in items.items()], "id string, content binary")


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,gif}").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path)


def json_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, pos, json) of files that hold an array of objects; pos counts within a file.

    With ``lines``, each line is an object; such files are read in splits, and pos ascends
    without being dense.
    """
    if lines:
        text = spark.read.text(path).where("trim(value) <> ''")
        return text.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("json"))
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.posexplode(F.from_json("value", "array<variant>")).alias("pos", "v")).select("path", "pos", F.to_json("v").alias("json"))


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a given schema saves the pass that infers one."""
    read = spark.read.option("header", "true")
    return (read.schema(schema) if schema else read.option("inferSchema", "true")).csv(path)


def patterned(spark: SparkSession, rows: int, size: int, kind: str = "text", seed: int = 42) -> DataFrame:
    """(id, content) of generated content: text, json, low_entropy, high_entropy, gradient_png, solid_png or docx; the same for the same seed.

    ``size`` is in bytes, of images the pixels of a side.
    """
    base = spark.range(rows)
    key = F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))
    if kind == "text":
        data = C.utf8(F.substring(F.repeat(F.concat(F.lit("The quick brown fox "), F.md5(key), F.lit(" jumps over the lazy dog. ")), size // 40 + 1), 1, size))
    elif kind == "json":
        item = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "level": "INFO", "active": true}'))
        data = C.utf8(F.concat(F.lit("["), F.array_join(F.array_repeat(item, max(size // 45, 1)), ", "), F.lit("]")))
    elif kind == "low_entropy":
        data = F.unhex(F.repeat(F.lit("DEADBEEF"), size // 4))
    elif kind == "high_entropy":
        data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(max(size // 32 - 1, 0))), lambda i: F.sha2(F.concat_ws("/", key, i.cast("string")), 256)), ""))
    elif kind in ("gradient_png", "solid_png"):
        data = _image_udf(kind, size, seed)(F.col("id"))
    elif kind == "docx":
        body = F.concat(F.lit('<?xml version="1.0"?><w:document xmlns:w="urn:w"><w:body><w:p><w:t>'), F.substring(F.repeat(F.concat(F.md5(key), F.lit(" ")), size // 33 + 1), 1, size), F.lit("</w:t></w:p></w:body></w:document>"))
        names = F.array(F.lit("[Content_Types].xml"), F.lit("_rels/.rels"), F.lit("word/document.xml"))
        data = archives.zip_of(names, F.array(C.utf8(F.lit("<Types/>")), C.utf8(F.lit("<Relationships/>")), C.utf8(body)))
    else:
        raise ValueError(f"no content of kind {kind}")
    return base.select("id", data.alias("content"))


def _image_udf(kind: str, size: int, seed: int):
    @F.arrow_udf(T.BinaryType())
    def draw(ids: pa.Array) -> pa.Array:
        out = []
        for i in ids.to_pylist():
            start, stop = np.random.default_rng([seed, i]).integers(0, 256, (2, 3)).tolist()
            out.append(raster.write("PNG", gradients.render({"width": size, "height": size, "angle": 90 * (i % 2), "start": start, "stop": stop if kind == "gradient_png" else start})))
        return pa.array(out, pa.binary())

    return draw


#: (file name, kind, size) of a mixed collection of ten files.
COLLECTION = (
    ("text_small.txt", "text", 10_000), ("text_medium.txt", "text", 100_000), ("text_large.txt", "text", 1_000_000), ("log_medium.json", "json", 200_000), ("log_large.json", "json", 1_000_000),
    ("low_entropy.bin", "low_entropy", 500_000), ("high_entropy.bin", "high_entropy", 500_000), ("gradient_512.png", "gradient_png", 512), ("solid_256.png", "solid_png", 256), ("report.docx", "docx", 4000),
)


def collection(spark: SparkSession, seed: int = 42) -> DataFrame:
    """(path, content) of the files of COLLECTION."""
    out = None
    for path, kind, size in COLLECTION:
        one = patterned(spark, 1, size, kind, seed).select(F.lit(path).alias("path"), "content")
        out = one if out is None else out.unionByName(one)
    return out
