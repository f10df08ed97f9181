"""Byte windows: large content in consecutive windows that are compressed, checked and read one by one."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions import content as C
from sparkfold.functions.lineage import spread

from . import codecs

WINDOW = 16 << 20
LEVEL = 19
VERSION = "1.0"


def split(items: DataFrame, window: int = WINDOW, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, window_index, original_offset, original_size, checksum, data); empty content has no windows."""
    c = F.col(content)
    last = C.block_count(c, window) - 1
    rows = items.select(id_col, c.alias("_c"), F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("window_index"))
    rows = rows.select(id_col, "window_index", (F.col("window_index").cast("long") * window).alias("original_offset"), C.slice_of(F.col("_c"), F.col("window_index") * window, window).alias("data"))
    return rows.select(id_col, "window_index", "original_offset", C.size_of(F.col("data")).alias("original_size"), F.sha2("data", 256).alias("checksum"), "data")


def packer(level: int = LEVEL, codec: str | None = None):
    """zstd of a level, or a codec by its name."""
    named = codecs.codec(codec) if codec else None
    if named and not named.streaming:
        raise ValueError(f"{codec} doesn't take windows")

    @F.arrow_udf(T.BinaryType())
    def pack(data: pa.Array) -> pa.Array:
        if named:
            return pa.array([named.compress(v.as_py()) if v.is_valid else None for v in data], pa.binary())
        z = zstandard.ZstdCompressor(level=level)
        return pa.array([z.compress(v.as_buffer()) if v.is_valid else None for v in data], pa.binary())

    return pack


def unpacker(codec: str | None = None):
    """The window's bytes; null if it can't be read or its checksum is another."""
    named = codecs.codec(codec) if codec else None

    @F.arrow_udf(T.BinaryType())
    def unpack(packed: pa.Array, size: pa.Array, checksum: pa.Array) -> pa.Array:
        out, z = [], zstandard.ZstdDecompressor()
        for v, n, want in zip(packed, size.to_pylist(), checksum.to_pylist(), strict=True):
            try:
                data = None if not v.is_valid else named.decompress(v.as_py()) if named else z.decompress(v.as_buffer(), max_output_size=max(n, 1))
            except (zstandard.ZstdError, ValueError):
                data = None
            out.append(data if data is not None and hashlib.sha256(data).hexdigest() == want else None)
        return pa.array(out, pa.binary())

    return unpack


def compress(windows: DataFrame, level: int = LEVEL, codec: str | None = None) -> DataFrame:
    """Adds packed and compressed_size, drops data."""
    done = spread(windows).withColumn("packed", packer(level, codec)(F.col("data"))).drop("data")
    return done.withColumn("compressed_size", C.size_of(F.col("packed")))


def manifest(windows: DataFrame, size: str = "compressed_size", id_col: str = "id") -> DataFrame:
    """Adds stream_offset: what the windows before take."""
    before = Window.partitionBy(id_col).orderBy("window_index").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("stream_offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def progress(windows: DataFrame, size: str = "compressed_size", id_col: str = "id") -> DataFrame:
    """(id, window_index, done, total, ratio): original over compressed bytes so far."""
    so_far = Window.partitionBy(id_col).orderBy("window_index").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.round(F.try_divide(F.sum("original_size").over(so_far).cast("double"), F.sum(size).over(so_far)), 6)
    return windows.select(id_col, "window_index", (F.col("window_index") + 1).alias("done"), F.count(F.lit(1)).over(Window.partitionBy(id_col)).alias("total"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))


def seek(windows: DataFrame, index: int) -> DataFrame:
    """One window of every item; a negative index is an error."""
    if index < 0:
        raise ValueError("windows are counted from 0")
    return windows.where(F.col("window_index") == index)


def restore(packed: DataFrame, id_col: str = "id", codec: str | None = None) -> DataFrame:
    """(id, content): all windows in order; null if one is broken or missing."""
    data = packed.select(id_col, "window_index", unpacker(codec)("packed", "original_size", "checksum").alias("data"))
    whole = data.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("window_index", "data"))).alias("w"), F.count("data").alias("ok"), (F.max("window_index") + 1).alias("n"))
    return whole.select(id_col, C.joined(F.when(F.col("ok") == F.col("n"), F.col("w.data"))).alias("content"))


def checked(data: Column, checksum: Column) -> Column:
    return F.sha2(data, 256) == checksum


def manifest_json(windows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, manifest): totals and windows of each item as JSON, of rows that manifest() made."""
    one = F.struct("window_index", "original_offset", "original_size", "compressed_size", "stream_offset", "checksum")
    rows = windows.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).alias("windows"), F.sum("original_size").alias("total_original_size"), F.sum("compressed_size").alias("total_compressed_size"), F.count(F.lit(1)).alias("window_count"))
    return rows.select(id_col, F.to_json(F.struct(F.lit(VERSION).alias("format_version"), "total_original_size", "total_compressed_size", "window_count", "windows")).alias("manifest"))


def manifest_rows(manifests: DataFrame, id_col: str = "id") -> DataFrame:
    """The windows of manifests (id, manifest), with the format version; the way back from manifest_json."""
    kind = "format_version string, windows array<struct<window_index:int,original_offset:long,original_size:long,compressed_size:long,stream_offset:long,checksum:string>>"
    m = manifests.select(id_col, F.from_json("manifest", kind).alias("m")).select(id_col, "m.format_version", F.explode("m.windows").alias("w"))
    return m.select(id_col, "format_version", "w.*")
