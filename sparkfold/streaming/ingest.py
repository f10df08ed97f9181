"""Incremental ingest: block references, similarity bands and byte windows from streams of new content.

Each micro-batch is written to a folder of its own number, so a batch that is repeated
after a failure replaces itself; readers see what the folders hold together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from sparkfold.functions import content as C
from sparkfold.functions.lineage import cut
from sparkfold.operators import cas, lsh, windows


def content_stream(spark: SparkSession, path: str, schema: StructType, text: str = "text", id_col: str = "doc_id", files: int = 1) -> DataFrame:
    """(id, content) of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).select(id_col, C.utf8(F.col(text)).alias("content"))


def _into(folder: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def start(stream: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Takes what is there now and ends; the next start goes on after it."""
    return stream.writeStream.foreachBatch(_into(f"{folder}/data", make)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def ingest_blocks(stream: DataFrame, folder: str, block: int, id_col: str = "doc_id") -> StreamingQuery:
    return start(stream, folder, lambda b: cas.block_store(b, block, id_col))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """The block store of all batches."""
    every = spark.read.parquet(f"{folder}/data")
    return every.groupBy("hash").agg(F.max("size").alias("size"), F.sum("ref_count").alias("ref_count"))


def ingest_signatures(stream: DataFrame, folder: str, id_col: str = "doc_id", threshold: float = lsh.THRESHOLD) -> StreamingQuery:
    """An index that grows: each batch is probed against the stored bands, and its new signatures, its members and the pairs that it adds are stored.

    An item whose signature is known already is a member of the item that brought it,
    so copies are neither indexed nor paired again.
    """
    spark = stream.sparkSession

    def stored(name: str, number: int, schema: str) -> DataFrame:
        """What batches before this one hold."""
        path = f"{folder}/{name}"
        rows = spark.read.schema(f"{schema}, batch long").option("pathGlobFilter", "*.parquet").parquet(path) if exists(spark, path) else spark.createDataFrame([], f"{schema}, batch long")
        return rows.where(F.col("batch") < number).drop("batch")

    def write(batch: DataFrame, number: int) -> None:
        kind = batch.schema[id_col].dataType.simpleString()
        heads, member = lsh.classes(batch, id_col)
        keyed = heads.select("id", "sig", F.sha2(F.array_join("sig", "-"), 256).alias("k"))
        known = stored("index", number, f"id {kind}, sig array<long>, k string")
        found = cut(keyed.join(known.select("k", F.col("id").alias("_first")), "k", "left"))
        fresh = found.where("_first IS NULL").select("id", "sig", "k")
        bands_of = lsh.packed_bands(fresh)
        old = stored("bands", number, f"id {kind}, band int, key {bands_of.schema['key'].dataType.simpleString()}")
        mixed = bands_of.toDF("x", "band", "key").join(old.toDF("y", "band", "key"), ["band", "key"]).select("x", "y").distinct()
        pairs = lsh.candidates(bands_of).unionByName(mixed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        near = lsh.verified(pairs, fresh.select("id", "sig").unionByName(known.select("id", "sig")), threshold)
        heads_of = found.select(F.col("id").alias("head"), F.coalesce("_first", "id").alias("_head"))
        for name, rows in (("pairs", near), ("members", member.join(heads_of, "head").select("id", F.col("_head").alias("head"))), ("bands", bands_of), ("index", fresh)):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The similar pairs (a, b, jaccard) that all batches found, of representatives."""
    return spark.read.parquet(f"{folder}/pairs").select("a", "b", "jaccard")


def read_members(spark: SparkSession, folder: str) -> DataFrame:
    """(id, head) of all items: the first one with the same signature."""
    return spark.read.parquet(f"{folder}/members").select("id", "head")


class Progress(StreamingQueryListener):
    """Calls ``tell(batches, rows, rows a second)`` after each micro-batch; add it with ``spark.streams.addListener``."""

    def __init__(self, tell: Callable[[int, int, float], None]):
        self.tell, self.batches, self.rows = tell, 0, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches, self.rows = self.batches + 1, self.rows + (p.numInputRows or 0)
        self.tell(self.batches, self.rows, p.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def ingest_windows(stream: DataFrame, folder: str, window: int, id_col: str = "doc_id", level: int = windows.LEVEL) -> StreamingQuery:
    return start(stream, folder, lambda b: windows.compress(windows.split(b, window, id_col), level))


def read_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The windows of all batches, as ``windows.restore`` takes them."""
    return spark.read.parquet(f"{folder}/data").drop("batch")


def event_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; works on streams and tables."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
