"""Small DataFrame helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions.lineage import cut, shared_folder, sized, small_batches  # noqa: F401
from sparkfold.operators.columnar import with_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name that may have dots, blanks or backticks in it, as a reference."""
    return "`" + name.replace("`", "``") + "`"


def of(docs: DataFrame, name: str) -> Column:
    """The column called exactly ``name``."""
    return docs[quoted(name)]


def wrapped(docs: DataFrame, **extra: Column) -> DataFrame:
    """Every column of ``docs`` in one struct ``_row`` beside ``extra``, so no name can clash.

    ``extra`` is computed from the columns of ``docs``; ``select("_row.*")`` restores them.
    """
    return docs.select(F.struct(*[of(docs, c).alias(c) for c in docs.columns]).alias("_row"), *[c.alias(k) for k, c in extra.items()])


def typed(*fields: T.StructField | str) -> T.StructType:
    """A schema of fields and DDL strings, for types that a DDL string can't name (columns with odd names)."""
    return T.StructType([f for x in fields for f in (T.StructType.fromDDL(x).fields if isinstance(x, str) else [x])])


def id_field(docs: DataFrame, name: str, called: str) -> T.StructField:
    """The id column's field under another name."""
    return T.StructField(called, docs.schema[name].dataType)


def numbered(ids: DataFrame) -> DataFrame:
    """(id, n) of a table of distinct ids: numbers in the order of the ids, without a global sort."""
    return cut(with_position(ids.select("id"), "id", "n").select("id", "n"))


def comparable(a: Column, b: Column, left: T.DataType, right: T.DataType) -> Column:
    """a = b for id columns of two tables; as strings, if their types differ."""
    return a == b if left == right else a.cast("string") == b.cast("string")


def hash60(c: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a non-negative long (the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def bounded(rows: DataFrame, n: int) -> DataFrame:
    """Of rows (_id, _key), at most ``n`` distinct ids of each key: those with the smallest hashes.

    Most rows leave before the ranking shuffle: only hashes in the lowest part that
    holds about 2 n ids of a key are ranked.
    """
    counts = cut(rows.groupBy("_key").agg(F.approx_count_distinct("_id").alias("_n")))
    near = rows.join(sized(counts), "_key").withColumn("_u", F.pmod(F.xxhash64("_id"), F.lit(1 << 52)) / float(1 << 52))
    near = near.where(F.col("_u") * F.col("_n") < 2 * n + 100).distinct()
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_u", "_id"))
    return cut(near.withColumn("_r", rank).where(F.col("_r") <= n).select("_id", "_key"))
