"""Similarity of binary content: MinHash over 8-byte shingles at stride 4, banding, verified pairs, clusters.

Shingles are read as little-endian numbers, reduced modulo P = 2^31 - 1, and hashed by
(a x + b) mod P with 128 seeded pairs (a, b), exactly. Content of 1 to 7 bytes has one
shingle, the first 8 bytes of its MD5; empty content has no signature and no partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions import content as C
from sparkfold.functions.lineage import cut, spread

from .columnar import with_position
from .graph import components

P = (1 << 31) - 1
PERMUTATIONS, BANDS, THRESHOLD, DUPLICATE = 128, 32, 0.5, 0.95
#: Bytes of content whose shingles are held at once, a multiple of 4.
PIECE = 1 << 20
#: Shingles that are hashed at once, so that the numbers stay in the cache, and what their number is filled up to a multiple of.
STEP, FILL = 256, 64
#: Items whose slots leave Python in one batch.
ROWS = 256


def coefficients(n: int = PERMUTATIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, P, n).astype(np.int64), rng.integers(0, P, n).astype(np.int64)


def _shingles(data: bytes | memoryview) -> np.ndarray:
    """The shingles modulo P, as often as they occur."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    if n < 8:
        data = hashlib.md5(bytes(data)).digest()[:8]
    w = np.frombuffer(data, "<u4", count=len(data) // 4).astype(np.int64)
    return (w[:-1] + 2 * (w[1:] % P)) % P  # 2^32 = 2 modulo P


def reduced_shingles(data: bytes | memoryview) -> np.ndarray:
    """The distinct shingles modulo P."""
    return np.unique(_shingles(data))


@cache
def _scratch(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What minima() of n slots works in, kept by the worker: new memory for each step costs more than the sums."""
    return np.empty(n * STEP, np.uint64), np.empty(n * STEP, np.uint64), np.empty(n * STEP, np.uint32), np.empty(n * STEP, np.uint32)


@lru_cache(maxsize=16)
def _repeated(coefficients: bytes, k: int) -> np.ndarray:
    """Each of the coefficients k times: flat arrays of one length are multiplied twice as fast as a column by a row."""
    return np.repeat(np.frombuffer(coefficients, np.uint64), k)


def _lowest(x: np.ndarray, a: bytes, b: bytes, best: np.ndarray) -> None:
    """Lowers ``best`` (32 bits) to the least (a x + b) modulo P of every slot.

    a x + b < 2^62, so its two halves of 31 bits add up to less than 2 P: one more
    subtraction reduces them, and where none is due it wraps to a greater number. A
    step is filled up with its first shingle, which changes no minimum.
    """
    n, p = len(best), np.uint32(P)
    for lo in range(0, len(x), STEP):
        some = x[lo : lo + STEP]
        k = -(-len(some) // FILL) * FILL
        wide, high, low, less = (s[: n * k] for s in _scratch(n))
        rows = wide.reshape(n, k)
        rows[:, : len(some)] = some
        rows[:, len(some) :] = some[0]
        np.multiply(wide, _repeated(a, k), out=wide)
        np.add(wide, _repeated(b, k), out=wide)
        np.right_shift(wide, np.uint64(31), out=high)
        np.bitwise_and(wide, np.uint64(P), out=wide)
        np.add(wide, high, out=low, casting="unsafe")
        np.subtract(low, p, out=less)
        np.minimum(low, less, out=low)
        np.minimum(best, low.reshape(n, k).min(1), out=best)


def minima(data: bytes | memoryview, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The signature of one content; None for an empty one."""
    if not len(data):
        return None
    best = np.full(len(a), P, np.uint32)
    one, two = a.astype(np.uint64).tobytes(), b.astype(np.uint64).tobytes()
    for at in range(0, len(data), PIECE):  # pieces share a word, so no shingle is lost between them
        piece = data[at : at + PIECE + 4]
        if at and len(piece) < 8:
            break
        _lowest(_shingles(piece).astype(np.uint64), one, two, best)
    return best.astype(np.int64)


def signature_udf(n: int = PERMUTATIONS, seed: int = 42):
    """Binary content to its n minima; null for empty or null content."""
    a, b = coefficients(n, seed)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signature(content: pa.Array) -> pa.Array:
        return pa.array([minima(memoryview(v.as_buffer()), a, b) if v.is_valid else None for v in content], pa.list_(pa.int64()))

    return signature


def keyed_udf(n: int = PERMUTATIONS, seed: int = 42):
    """Binary content to its n minima and their SHA-256, which costs the JVM more than the worker; null for empty or null content."""
    a, b = coefficients(n, seed)

    @F.arrow_udf(T.StructType.fromDDL("sig array<bigint>, k binary"))
    def keyed(content: pa.Array) -> pa.Array:
        found = [minima(memoryview(v.as_buffer()), a, b) if v.is_valid else None for v in content]
        keys = [None if m is None else hashlib.sha256(m.tobytes()).digest() for m in found]
        return pa.StructArray.from_arrays([pa.array(found, pa.list_(pa.int64())), pa.array(keys, pa.binary())], ["sig", "k"])

    return keyed


@F.arrow_udf(T.LongType())
def shingle_count(content: pa.Array) -> pa.Array:
    return pa.array([len(reduced_shingles(v.as_buffer().to_pybytes())) if v.is_valid else None for v in content], pa.int64())


def signatures(items: DataFrame, id_col: str = "id", content: str = "content", permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, sig) of items with content, of the whole content."""
    some = spread(items.where(C.size_of(F.col(content)) > 0).select(id_col, content))
    return some.select(F.col(id_col).alias("id"), signature_udf(permutations)(F.col(content)).alias("sig"))


def keyed_signatures(items: DataFrame, id_col: str = "id", content: str = "content", permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, sig, k) of items with content: k is the same for equal signatures only."""
    some = spread(items.where(C.size_of(F.col(content)) > 0).select(id_col, content))
    return some.select(F.col(id_col).alias("id"), keyed_udf(permutations)(F.col(content)).alias("_s")).select("id", "_s.sig", "_s.k")


def signature_slots(items: DataFrame, id_col: str = "id", content: str = "content", permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, i, m): the signatures slot by slot. They are rows of one Python pass: a generator over an array column would put a filter on it, and with it the function, before the rows are spread."""
    a, b = coefficients(permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):  # each row becomes one for every slot
                part = batch.slice(lo, ROWS)
                found = [minima(memoryview(v.as_buffer()), a, b) for v in part.column(1)]
                at = np.repeat(np.arange(len(found)), permutations)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(permutations, dtype=np.int32), len(found))), pa.array(np.concatenate(found), pa.int64())], names=["id", "i", "m"])

    some = spread(items.where(C.size_of(F.col(content)) > 0).select(F.col(id_col).alias("id"), F.col(content).alias("content")))
    return some.mapInArrow(run, T.StructType([some.schema["id"], *T.StructType.fromDDL("i int, m long").fields]))


def band_table(signed: DataFrame, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, band, key): the index, an exact key for every band."""
    if permutations % bands:
        raise ValueError("permutations must be a multiple of bands")
    r = permutations // bands
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_join(F.slice("sig", i * r + 1, r), "-"))
    return signed.select("id", F.posexplode(keys).alias("band", "key"))


def agreement(a: Column, b: Column, permutations: int = PERMUTATIONS) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / permutations


def packed_bands(signed: DataFrame, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, band, key) as band_table() has it, for joins: two slots of 31 bits in one long, so a key takes a fifth of its text and is as exact."""
    if permutations % bands:
        raise ValueError("permutations must be a multiple of bands")
    r = permutations // bands

    def key(i: int) -> Column:
        pairs = [F.shiftleft(F.get("sig", F.lit(at)), 31).bitwiseOR(F.get("sig", F.lit(at + 1))) if at + 1 < (i + 1) * r else F.get("sig", F.lit(at)) for at in range(i * r, (i + 1) * r, 2)]
        return F.struct(*[p.alias(f"k{n}") for n, p in enumerate(pairs)])

    return signed.select("id", F.posexplode(F.array(*map(key, range(bands)))).alias("band", "key"))


def candidates(bands: DataFrame) -> DataFrame:
    """(a, b), a < b, of ids that share a band. Rows are joined by the numbers of the key, the first of which tells most of them apart when they are sorted; a struct or the band doesn't."""
    key = bands.schema["key"].dataType
    parts = [F.col(f"key.{f}") for f in key.fieldNames()] if isinstance(key, T.StructType) else [F.col("key")]
    flat = bands.select("id", *[c.alias(f"_k{i}") for i, c in enumerate(parts)], "band")
    on = flat.columns[1:]
    one, two = flat.withColumnRenamed("id", "a"), flat.withColumnRenamed("id", "b")
    return one.join(two, on).where("a < b").select("a", "b").distinct()


def verified(pairs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> DataFrame:
    """(a, b, jaccard) of candidate pairs whose signatures agree enough; the threshold is applied before rounding."""
    one = pairs.join(signed.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    two = one.join(signed.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    found = two.select("a", "b", agreement(F.col("sa"), F.col("sb"), permutations).alias("j")).where(F.col("j") >= threshold)
    return found.select("a", "b", F.round("j", 4).alias("jaccard"))


def classes(items: DataFrame, id_col: str = "id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """((id, sig, copies) of each distinct signature under its smallest id, (id, head) of every item). Items without an id can't be named and take no part."""
    signed = cut(keyed_signatures(items.where(F.col(id_col).isNotNull()), id_col, content))
    heads = cut(signed.groupBy("k").agg(F.min("id").alias("id"), F.min_by("sig", "id").alias("sig"), F.count(F.lit(1)).alias("copies")))
    member = cut(signed.select("id", "k").join(heads.select("k", F.col("id").alias("head")), "k").select("id", "head"))
    return heads.select("id", "sig", "copies"), member


def similar_pairs(heads: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(a, b, jaccard), a < b, of distinct signatures (id, sig): pairs of representatives, however many copies each has."""
    return verified(candidates(packed_bands(heads, bands)), heads, threshold)


def links(items: DataFrame, id_col: str = "id", content: str = "content", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): edges that connect all similar items: those of the representatives, and each copy with its own; as many as items and pairs of representatives, not as pairs of copies."""
    return linked(*classes(items, id_col, content), threshold)


def linked(heads: DataFrame, member: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """links() of what classes() gave."""
    return similar_pairs(heads.select("id", "sig"), threshold).select("a", "b").unionByName(member.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))


def query_similar(queries: DataFrame, heads: DataFrame, member: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(query_id, id, jaccard, copies): for ids of indexed items (id), the similar representatives and how many other items each stands for."""
    asked = member.join(queries.select("id"), "id").withColumnRenamed("id", "query_id")
    own = asked.select("head").distinct()
    keys = packed_bands(heads.select("id", "sig"), bands)
    mine = keys.join(own.withColumnRenamed("head", "id"), "id")
    hits = mine.toDF("a", "band", "key").join(keys.toDF("b", "band", "key"), ["band", "key"]).where("a <> b").select("a", "b").distinct()
    near = verified(hits, heads.select("id", "sig"), threshold).unionByName(own.select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("jaccard")))
    found = asked.join(near.withColumnRenamed("a", "head"), "head").join(heads.select(F.col("id").alias("b"), "copies"), "b")
    others = F.col("copies") - F.when(F.col("b") == F.col("head"), 1).otherwise(0)
    return found.select("query_id", F.col("b").alias("id"), "jaccard", others.alias("copies")).where("copies > 0")


def duplicates(items: DataFrame, id_col: str = "id", content: str = "content", threshold: float = DUPLICATE, bands: int = BANDS) -> DataFrame:
    """(query_id, is_duplicate) of every row, against all other rows; rows are matched by their signatures, so null and repeated ids take part."""
    signed = cut(keyed_signatures(items, id_col, content).withColumnRenamed("id", "query_id"))
    found = signed.groupBy("k").agg(F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    heads = cut(found.withColumn("id", F.monotonically_increasing_id()))  # numbers for the bands, which have 32 rows for each
    near = similar_pairs(heads.select("id", "sig"), threshold, bands)
    hit = heads.where("n > 1").select("id").unionByName(near.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    keys = heads.select("id", "k").join(hit, "id").select("k", F.lit(True).alias("_hit"))
    found = signed.select("query_id", "k").join(keys, "k", "left").select("query_id", F.coalesce("_hit", F.lit(False)).alias("is_duplicate"))
    blank = items.where(F.coalesce(C.size_of(F.col(content)), F.lit(0)) == 0).select(F.col(id_col).alias("query_id"), F.lit(False).alias("is_duplicate"))
    return found.unionByName(blank)


def most_similar(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs by falling similarity, then by their ids; with ``n``, the first of them."""
    order = pairs.orderBy(F.desc("jaccard"), "a", "b")
    return order if n is None else order.limit(n)


def numbered_clusters(clustered: DataFrame) -> DataFrame:
    """(cluster_id, cluster_root, size): clusters numbered from the largest down, of equally large ones the smallest root first."""
    sizes = clustered.groupBy("cluster_root").agg(F.count(F.lit(1)).alias("size")).withColumn("_by", F.struct((-F.col("size")).alias("n"), "cluster_root"))
    return with_position(sizes, "_by", "cluster_id").select("cluster_id", "cluster_root", "size")


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster_root) of every item in a pair; the root is the smallest id."""
    found = components(pairs.select("a", "b"))
    return found.toDF("id", "cluster_root").unionByName(found.select(F.col("root").alias("id"), F.col("root").alias("cluster_root")).distinct())


def cluster_stats(clustered: DataFrame, signed: DataFrame) -> DataFrame:
    """(cluster_root, size, avg_similarity): the mean over all pairs of members, without forming them.

    In each slot, c members with one value agree in c (c - 1) / 2 pairs; added over
    values and slots and divided by slots and pairs this is the mean agreement. ``signed``
    has (id, sig) of all members, or (id, sig, copies) of the representatives that
    classes() gives, each of which counts as often as it has copies.
    """
    times = F.col("copies") if "copies" in signed.columns else F.lit(1)
    own = clustered.join(signed.select("id", "sig", times.cast("long").alias("times")), "id")
    slots = own.select("cluster_root", "times", F.posexplode("sig").alias("slot", "v")).groupBy("cluster_root", "slot", "v").agg(F.sum("times").alias("c"))
    agree = slots.groupBy("cluster_root").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("agree"))
    sizes = clustered.groupBy("cluster_root").agg(F.count(F.lit(1)).alias("size"))
    pairs = F.expr("size * (size - 1) div 2")
    return sizes.join(agree, "cluster_root").select("cluster_root", "size", F.round(F.col("agree") / pairs / PERMUTATIONS, 4).alias("avg_similarity"))


def detection_odds(similarity: Column, bands: int = BANDS, permutations: int = PERMUTATIONS) -> Column:
    """The chance that a pair of this similarity becomes a candidate."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(permutations // bands)), F.lit(bands))
