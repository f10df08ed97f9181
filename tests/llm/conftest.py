import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use themselves
        T.StructField("id", T.StringType()),
        T.StructField("_row", T.IntegerType()),
        T.StructField("_h", T.IntegerType()),
        T.StructField("keep", T.BooleanType()),
        T.StructField("node", T.LongType()),
    ]
)
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (3, "der schnelle braune Fuchs springt über den faulen Hund und läuft weit weg", "de", "a"),
    (4, None, "en", "b"),
    (5, None, None, None),
    (6, "", "en", "b"),
    (7, "", "fr", None),
    (8, "... !!! ???", "en", "c"),
    (9, "x", "en", "c"),
    (10, "word " * 60_000, "en", "c"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (11, "le renard brun rapide saute par dessus le chien paresseux et court très loin", "fr", "b"),
    (11, "le renard brun rapide saute par dessus le chien paresseux et court très loin", "fr", "b"),
    (12, "Быстрая коричневая лиса прыгает через ленивую собаку", None, "d"),
    (13, "\u0000퟿ 漢字 かな mixed 한국어 text", "ja", "d"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    rows = [(i, t, lang, s, f"x{n}", n, n % 2, True, 7) for n, (i, t, lang, s) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
