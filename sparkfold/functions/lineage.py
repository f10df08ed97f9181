"""Reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 16 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset, a temporary folder on a local master, and an error on a cluster."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkfold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def sized(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised table, marked for broadcast if it has at most ``limit`` rows and ``most`` bytes, strings and binaries counted as long as they are."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((_width(f) for f in df.schema.fields), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most else df


def _width(field: T.StructField) -> Column:
    """Bytes of a value, about."""
    c = F.col(_quoted(field.name))
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold about BATCH_BYTES, however long the texts, unless the session has a limit of its own.

    Without it a batch is 10000 rows: of texts of 100 KB, a gigabyte on both sides of the pipe.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if there are fewer input partitions than cores; larger inputs aren't moved, nor is what a shuffle spreads already (asking for its partitions would run it). What follows in Python gets small batches."""
    small_batches(df)
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
