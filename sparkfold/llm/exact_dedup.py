"""Exact dedup: 128-bit content hashes, confirmed byte by byte inside each group.

Only (hash, id) pairs are shuffled for all rows. The texts that are compared are
those whose hash occurs more than once, and copies of one text in one input
partition collapse before the shuffle, so a text with millions of copies is not a
hot key.

Defined results
    * null text: there is no content to compare; every such row is kept and its
      own group (``copies`` 1).
    * empty text: empty texts are equal to each other.
    * ties: the smallest id stays; ids that are null sort last.
    * repeated rows (same id, same text): one of them stays, the one whose other
      columns sort first as JSON.
    * empty table: an empty result of the same schema.
    * extra columns, whatever they are called, are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, of, sized, wrapped


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _repeated(rows: DataFrame) -> DataFrame:
    """Hashes that occur more than once: (_h, _first, _n)."""
    return cut(
        rows.where("_text is not null").groupBy("_h").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )


def _rows(docs: DataFrame, doc_id: str, text: str, hash_fn: Callable[[Column], Column], carry: bool) -> DataFrame:
    cols = {"_id": of(docs, doc_id), "_text": of(docs, text), "_h": hash_fn(of(docs, text))}
    return wrapped(docs, **cols) if carry else docs.select(*[c.alias(k) for k, c in cols.items()])


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, kept_id, copies, keep) for every row: the smallest id with the same bytes, and how many rows have them.

    ``keep`` is true for the row whose id is ``kept_id``; see the module for nulls and ties.
    ``hash_fn`` exists so that tests can force collisions.
    """
    rows = _rows(docs, doc_id, text, hash_fn, carry=False)
    repeated = _repeated(rows)
    keys = sized(repeated)
    # the byte comparison: grouping by (hash, text) keeps two texts with one hash apart
    classes = rows.join(keys.select("_h"), "_h", "left_semi").where("_text is not null").groupBy("_h", "_text").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    collided = cut(classes.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_h"))
    ids = rows.select("_id", "_h", F.col("_text").isNull().alias("_none"))
    plain = ids.join(sized(repeated), "_h", "left")
    if collided.isEmpty():
        found = plain.select("_id", F.when(~F.col("_none"), F.col("_first")).alias("_first"), F.when(~F.col("_none"), F.col("_n")).alias("_n"))
    else:
        apart = sized(collided)
        same = plain.join(apart, "_h", "left_anti").select("_id", F.when(~F.col("_none"), F.col("_first")).alias("_first"), F.when(~F.col("_none"), F.col("_n")).alias("_n"))
        by_text = rows.join(apart, "_h", "left_semi").join(classes, ["_h", "_text"], "left").select("_id", "_first", "_n")
        found = same.unionByName(by_text)
    kept = F.coalesce("_first", "_id")
    return found.select(
        F.col("_id").alias("doc_id"),
        kept.alias("kept_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("copies"),
        F.coalesce(F.col("_id") == kept, F.col("_first").isNull()).alias("keep"),
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` with one row for each distinct text, all columns unchanged.

    Rows whose hash is unique pass without a shuffle of their text.
    """
    rows = _rows(docs, doc_id, text, hash_fn, carry=True)
    keys = sized(_repeated(_rows(docs, doc_id, text, hash_fn, carry=False)).select("_h", F.lit(True).alias("_again")))
    marked = rows.join(keys, "_h", "left")
    alone = marked.where("_again is null or _text is null").select("_row.*")
    # the rank limit is applied in each input partition before the shuffle
    order = Window.partitionBy("_h", "_text").orderBy(F.col("_id").asc_nulls_last(), F.to_json("_row"))
    first = marked.where("_again and _text is not null").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("_row.*")
    return alone.unionByName(first)
