"""From raw documents to packed training sequences: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``; the last returns a row for each packed sequence.

Defined results: rows without a text have no language and leave with the first stage, as
do texts of numbers or symbols only; rows with a null id are packed like others; empty
tables give empty results; columns beyond those of ``documents``, whatever they are
called, are carried to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfold.functions.lineage import remove, shared_folder
from sparkfold.llm import exact_dedup, langid, minhash, mixing, packing
from sparkfold.llm.frames import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which known languages, one or more, explain less than half of the words."""
    return langid.keep(docs, langid.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as came in, drawn to sources' shares by square-root counts."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most packing.CAPACITY tokens: their text, and which piece of which document begins where."""
    return packing.sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express language identification, signatures or best-fit packing; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. Stages are written in a folder of their own beside the checkpoints; one leaves when the next is there."""
    return staged(spark, table(spark, sf_dir, "documents"), sf_dir)


def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages applied to ``docs``."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
