"""Extendible-hash sharding: split only the buckets that are too large.

A directory is indexed by leading bits of a 60-bit hash of the id. A bucket that
exceeds the byte limit is split on its next bit; all others stay as they are, so
shard ids have different lengths. The bytes are added up per hash prefix of STEP
more bits, and the split tree of STEP levels is read off those sums, so the rows
of the table are aggregated once per STEP bits and not once per bit. Text never
moves: only ids, hashes and lengths do.

Defined results
    * null id: hashed as an empty string.
    * null text: 0 bytes, like an empty one; the row still gets a shard.
    * a row larger than the limit, or rows that share one hash (repeated ids): no
      bit can part them; they get a shard of their own at full depth, marked
      ``oversized``.
    * empty table: an empty result.
    * extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, hash60, of, sized

BITS = 60
STEP = 12


def assign(docs: DataFrame, limit_bytes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shard, depth, bytes, shard_bytes, shard_rows, oversized): each row's leaf in the directory.

    ``shard`` is the leaf's bit string ("" if everything fits one shard), ``depth`` its length.
    """
    rows = docs.select(
        of(docs, doc_id).alias("_id"),
        hash60(F.coalesce(of(docs, doc_id).cast("string"), F.lit(""))).alias("_hash"),
        F.coalesce(F.octet_length(of(docs, text)), F.lit(0)).cast("long").alias("_bytes"),
    )
    pending, leaves = None, None
    for base in range(0, BITS, STEP):
        # bytes by prefix of base + STEP bits, within buckets that are still too large
        deep = base + STEP
        prefix = F.shiftright("_hash", BITS - deep)
        sums = rows
        if pending is not None:
            sums = rows.join(sized(pending), F.shiftright("_hash", BITS - base) == F.col("_over"), "left_semi")
        sums = sums.groupBy(prefix.alias("_p")).agg(F.sum("_bytes").alias("_b"), F.count(F.lit(1)).alias("_n"))
        levels = sums.select(F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("_d"), "_p", "_b", "_n")
        nodes = cut(levels.groupBy("_d", F.expr(f"shiftright(_p, {deep} - _d)").alias("_node")).agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n")))
        over = nodes.where(F.col("_b") > limit_bytes)
        split = over.select((F.col("_d") + 1).alias("_d"), F.col("_node").alias("_parent"))
        fits = nodes.where((F.col("_b") <= limit_bytes) | ((F.col("_d") == BITS) if deep >= BITS else F.lit(False)))
        found = fits.where("_d > 0").withColumn("_parent", F.shiftright("_node", 1)).join(split, ["_d", "_parent"], "left_semi").select("_d", "_node", "_b", "_n")
        if base == 0:
            found = found.unionByName(fits.where("_d = 0"))
        leaves = found if leaves is None else leaves.unionByName(found)
        pending = cut(over.where(F.col("_d") == deep).select(F.col("_node").alias("_over")))
        if pending.isEmpty():
            break
    leaves = cut(leaves)
    depths = [r[0] for r in leaves.select("_d").distinct().collect()]  # at most BITS + 1 values
    keyed = rows.withColumn("_at", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))) if depths else rows.withColumn("_at", F.lit(0))
    keyed = keyed.withColumn("_node", F.expr(f"shiftright(_hash, {BITS} - _at)"))
    hit = keyed.join(sized(leaves.withColumnRenamed("_d", "_at")), ["_at", "_node"])
    shard = F.when(F.col("_at") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(_node), _at, '0')"))
    return hit.select(
        F.col("_id").alias("doc_id"),
        shard.alias("shard"),
        F.col("_at").cast("int").alias("depth"),
        F.col("_bytes").alias("bytes"),
        F.col("_b").alias("shard_bytes"),
        F.col("_n").alias("shard_rows"),
        (F.col("_b") > limit_bytes).alias("oversized"),
    )
