"""Content-addressed storage: blocks by SHA-256, recipes, statistics, exact similarity of block sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.functions.lineage import cut

BLOCK = 64 << 10


def blocks(items: DataFrame, block: int = BLOCK, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, pos, data, size, hash) of consecutive blocks, tail included."""
    c = F.col(content)
    last = C.block_count(c, block) - 1
    cut_up = items.select(id_col, c.alias("_c"), F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("pos"))
    cut_up = cut_up.select(id_col, "pos", C.slice_of(F.col("_c"), F.col("pos") * block, block).alias("data"))
    return cut_up.withColumns({"size": C.size_of(F.col("data")), "hash": F.sha2("data", 256)})


def recipes(items: DataFrame, block: int = BLOCK, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, pos, hash): which blocks make up each item, in order."""
    return blocks(items, block, id_col, content).select(id_col, "pos", "hash")


def block_store(items: DataFrame, block: int = BLOCK, id_col: str = "id", content: str = "content", data: bool = False) -> DataFrame:
    """(hash, size, ref_count[, data]) of distinct blocks; combined before the shuffle."""
    found = [F.first("data").alias("data")] if data else []
    return blocks(items, block, id_col, content).groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("ref_count"), *found)


def stats(items: DataFrame, block: int = BLOCK, id_col: str = "id", content: str = "content") -> DataFrame:
    """One row: what block dedup saves on these items."""
    store = block_store(items, block, id_col, content)
    unique = store.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_unique_size"), F.count(F.lit(1)).alias("block_count"), F.coalesce(F.sum(F.col("ref_count") - 1), F.lit(0)).alias("duplicate_blocks"))
    whole = items.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(C.size_of(F.col(content))), F.lit(0)).alias("total_original_size"))
    saved = F.col("total_original_size") - F.col("total_unique_size")
    both = whole.crossJoin(unique)  # one row each
    ratio = F.round(F.col("total_original_size") / F.greatest("total_unique_size", F.lit(1)), 6)
    return both.withColumns({"dedup_ratio": ratio, "saved_bytes": saved, "saved_pct": F.coalesce(F.round(F.try_divide(saved * 100.0, F.col("total_original_size")), 6), F.lit(0.0))})


def reconstruct(recipe: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, content) from recipes (id, pos, hash) and a store (hash, data); a missing block makes the content null."""
    parts = recipe.join(store.select("hash", "data"), "hash", "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("p"), F.count(F.when(F.col("data").isNull(), 1)).alias("_lost"))
    return parts.select(id_col, C.joined(F.when(F.col("_lost") == 0, F.col("p.data"))).alias("content"))


def missing_blocks(recipe: DataFrame, store: DataFrame) -> DataFrame:
    """Recipe rows whose block the store lacks."""
    return recipe.join(store.select("hash"), "hash", "left_anti")


def block_sets(items: DataFrame, block: int = BLOCK, id_col: str = "id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """((id, hash, n) of the blocks of each distinct set under its smallest id, (id, head) of every item with blocks)."""
    own = cut(blocks(items, block, id_col, content).select(F.col(id_col).alias("id"), "hash").distinct())
    sets = cut(own.groupBy("id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("key"), F.count(F.lit(1)).alias("n")))
    heads = cut(sets.groupBy("key").agg(F.min("id").alias("head"), F.max("n").alias("n")))
    return own.join(heads.select(F.col("head").alias("id"), "n"), "id"), sets.join(heads.select("key", "head"), "key").select("id", "head")


def jaccard_pairs(sets: DataFrame) -> DataFrame:
    """(a, b, inter, uni, jaccard) of all pairs a < b of distinct block sets that share a block, exactly; each stands for all items with its set."""
    left, right = sets.toDF("a", "hash", "na"), sets.toDF("b", "hash", "nb")
    shared = left.join(right, "hash").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("inter"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    uni = F.col("na") + F.col("nb") - F.col("inter")
    return shared.select("a", "b", "inter", uni.alias("uni"), F.round(F.col("inter") / uni, 6).alias("jaccard"))


def similarity_cells(heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, score): the cells of the similarity matrix of representatives (id) that aren't zero, both ways and the diagonal; every other cell is 0."""
    ways = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))
    shared = pairs.select(F.explode(ways).alias("w"), F.col("jaccard").alias("score")).select("w.i", "w.j", "score")
    own = heads.select(F.col("id").alias("i")).distinct()
    return shared.unionByName(own.select("i", F.col("i").alias("j"), F.lit(1.0).alias("score")))


def summary(stats: DataFrame) -> DataFrame:
    """(text): the statistics of a collection in a sentence."""
    return stats.select(F.format_string("%d files, %s as %s unique: %.2fx, %.1f %% saved, %d of %d blocks repeated", "file_count", C.human_size(F.col("total_original_size")), C.human_size(F.col("total_unique_size")), "dedup_ratio", "saved_pct", "duplicate_blocks", F.col("block_count") + F.col("duplicate_blocks")).alias("text"))


def duplicate_groups(items: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(hash, members, first_id) of content that occurs more than once; empty content has no hash and doesn't count."""
    hashed = items.where(C.size_of(F.col(content)) > 0).select(id_col, F.sha2(content, 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("members"), F.min(id_col).alias("first_id")).where("members > 1")


def merge_store(store: DataFrame, more: DataFrame) -> DataFrame:
    """A store grown by another one: reference counts add up."""
    return store.unionByName(more).groupBy("hash").agg(F.max("size").alias("size"), F.sum("ref_count").alias("ref_count"))


