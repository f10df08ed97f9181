"""Benchmark grids of files and strategies, and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPORT_COLUMNS = tuple("file_name file_size file_format strategy compressed_size ratio compression_ms decompression_ms peak_memory_kb lossless_verified error".split())


def grid(files: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Every file with every strategy; the list is a constant of the plan."""
    return files.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))


def speed(size: Column, ms: Column) -> Column:
    """MB/s; 0 without a time."""
    return F.when(ms > 0, size / float(1 << 20) / (ms / 1000.0)).otherwise(0.0)


def best_per_file(records: DataFrame, file: str = "file_id") -> DataFrame:
    """The record with the best ratio of each file; failures don't count, the first strategy by name wins ties."""
    order = Window.partitionBy(file).orderBy(F.desc("ratio"), "strategy")
    return records.where("error IS NULL").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def strategy_summary(records: DataFrame) -> DataFrame:
    """(strategy, records, avg_ratio, avg_compression_ms, avg_decompression_ms, all_lossless) of what didn't fail."""
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("ratio", "compression_ms", "decompression_ms")]
    return records.where("error IS NULL").groupBy("strategy").agg(F.count(F.lit(1)).alias("records"), *means, F.bool_and("lossless").alias("all_lossless"))


def ranking(records: DataFrame) -> DataFrame:
    """strategy_summary with the best mean ratio first."""
    return strategy_summary(records).orderBy(F.desc("avg_ratio"), "strategy")


def write_report(records: DataFrame, folder: str, kind: str = "csv") -> None:
    """The report as CSV with the eleven columns, or as JSON lines, by file and strategy; columns that are missing are empty."""
    out = records.select(*[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in REPORT_COLUMNS]).orderBy("file_name", "strategy")
    if kind == "csv":
        out.write.mode("overwrite").csv(folder, header=True)
    elif kind == "json":
        out.write.mode("overwrite").json(folder)
    else:
        raise ValueError("a report is csv or json")
