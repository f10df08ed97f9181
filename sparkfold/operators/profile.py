"""Entropy profiles of a table of binary content (id, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.functions import content as C


def byte_histogram(items: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, byte, n) of the bytes that occur."""
    counted = items.select(id_col, F.posexplode(C.histogram(F.col(content))).alias("byte", "n"))
    return counted.where("n > 0")


def entropy_report(items: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, n_bytes, entropy, est_ratio, label, is_random, is_highly_compressible) over the whole content."""
    e = F.col("entropy")
    base = items.select(id_col, C.size_of(F.col(content)).alias("n_bytes"), C.entropy(F.col(content)).alias("entropy"))
    return base.withColumns({"est_ratio": C.ratio_estimate(e), "label": C.compressibility_label(e), "is_random": C.is_random(e), "is_highly_compressible": C.is_highly_compressible(e)})


def block_entropies(items: DataFrame, block: int, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, block_index, entropy) of consecutive blocks; the tail is a block."""
    return items.select(id_col, F.posexplode(C.block_entropies(block)(F.col(content))).alias("block_index", "entropy"))


def block_entropy_stats(items: DataFrame, block: int, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, n_blocks, min_e, max_e, mean_e), without a shuffle; null statistics for empty content; halves of the last digit round up."""
    each = items.select(id_col, C.block_entropies(block)(F.col(content)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return each.select(id_col, F.size("e").cast("long").alias("n_blocks"), F.array_min("e").alias("min_e"), F.array_max("e").alias("max_e"), F.round(F.try_divide(total, F.size("e")) + 1e-9, 6).alias("mean_e"))
