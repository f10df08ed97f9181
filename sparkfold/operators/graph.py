"""Connected components of an edge table of long ids: local union-find, then star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.functions.lineage import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that isn't the smallest of its component."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(ids))
    x, y = at[: len(a)], at[len(a) :]
    while True:  # labels sink along edges and jump to their label's label
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:  # memory follows the nodes of a partition, not its edges
        a, b = forest(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that isn't the smallest of its component; rounds grow with the logarithm of its size."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(pairs.mapInArrow(_local, "a long, b long").distinct())
    tally = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1_000_000_007))]
    before = now.agg(*tally).first()
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = cut(small)
        after = small.agg(*tally).first()
        now, before, done = small, after, after == before
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
