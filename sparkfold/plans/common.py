"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.functions.lineage import small_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as (doc_id, content)."""
    return table(spark, sf_dir, "documents").select("doc_id", C.utf8(F.col("text")).alias("content"))


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v}'" if isinstance(v, str) else repr(v)


def values(rows: Sequence[Sequence[object]], names: str) -> str:
    """Rows as an SQL relation."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({names}))"


#: Blocks of documents as hex, for oracles: BLOBs can't be sliced in SQL.
def hex_blocks(block: int, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    w = 2 * block
    return f"""(SELECT {key}, i::INT AS pos, substr(h, (i * {w} + 1)::BIGINT, {w}) AS h
        FROM (SELECT {key}, hex(encode({text})) AS h FROM {table}), unnest(range(0, (length(h) + {w - 1}) // {w})) AS u(i))"""
