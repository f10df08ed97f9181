"""Strategy selection: rules propose, a registry admits, a rank orders, attempts decide.

A report row has: file_id, format_type, mime_type, category, size, entropy, est_ratio, content_type,
content_confidence, generation, generation_confidence (the last four null where there is no image).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import CODECS

#: Strategies with an implementation that is registered by default.
REGISTERED = tuple(sorted(CODECS))
FALLBACK = "traditional_zstd"
#: (strategy, condition, estimated ratio, priority)
RULES = (
    ("procedural_gradient", "category = 'image' AND content_type = 'gradient' AND content_confidence > 0.7", "least(size / 200.0D, 50000.0D)", 1),
    ("procedural_cad", "format_type IN ('DWG', 'DXF')", "120.0D", 2),
    ("semantic_json", "format_type IN ('JSON', 'CSV') OR mime_type IN ('application/json', 'text/csv')", "CASE WHEN size > 50000 THEN 80.0D ELSE 30.0D END", 2),
    ("semantic_pdf", "format_type = 'PDF'", "10.0D", 3),
    ("semantic_screenshot", "category = 'image' AND content_type = 'screenshot' AND content_confidence > 0.6", "28.0D", 4),
    ("neural_medical", "category = 'medical'", "35.0D", 5),
    (FALLBACK, "true", "est_ratio", 50),
)
#: (hint, condition), in order
HINTS = (
    ("procedural_gradient", "generation = 'gradient' AND generation_confidence > 0.8"),
    ("semantic_screenshot", "content_type = 'screenshot'"),
    ("procedural_vector", "content_type = 'logo'"),
    ("semantic_json", "format_type IN ('JSON', 'CSV') OR mime_type IN ('application/json', 'text/csv')"),
    ("semantic_pdf", "format_type = 'PDF'"),
    ("semantic_office", "format_type IN ('DOCX', 'XLSX', 'PPTX')"),
    ("procedural_cad", "format_type IN ('DWG', 'DXF')"),
    ("neural_medical", "category = 'medical'"),
    (FALLBACK, "true"),
)
MEMORY_MB = {"traditional_lzma": 100}
MEMORY_DEFAULT_MB = 10


def hints(reports: DataFrame) -> DataFrame:
    """(file_id, hints, recommended): the strategies worth a try, the first one recommended."""
    each = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in HINTS]))
    return reports.select("file_id", each.alias("hints")).withColumn("recommended", F.coalesce(F.try_element_at("hints", F.lit(1)), F.lit(FALLBACK)))


def _proposed(names: Sequence[str] | None = None) -> Column:
    """The candidates of a report row as an array, of the named strategies only."""
    rules = [r for r in RULES if names is None or r[0] in names]
    each = [F.when(F.expr(c), F.struct(F.lit(p).alias("priority"), (-F.expr(r).cast("double")).alias("_less"), F.lit(s).alias("strategy"))) for s, c, r, p in rules]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<priority:int,_less:double,strategy:string>>")


def candidates(reports: DataFrame) -> DataFrame:
    """(file_id, strategy, est_ratio, priority) of every rule that applies."""
    return reports.select("file_id", F.explode(_proposed()).alias("c")).select("file_id", "c.strategy", (-F.col("c._less")).alias("est_ratio"), "c.priority")


def registered(found: DataFrame, names: Sequence[str] = REGISTERED) -> DataFrame:
    """Only candidates of known strategies; the list is a constant of the plan."""
    return found.where(F.col("strategy").isin(*names))


def ranking(names: Sequence[str] = REGISTERED) -> Column:
    """Of a report row, its candidates in order: by priority, estimate downwards, name; a strategy once, the fallback last if no rule gave it. At most as many as rules, so it is ranked in the row."""
    found = F.array_sort(_proposed(names))
    none = F.array().cast("array<struct<priority:int,_less:double,strategy:string>>")
    first = F.aggregate(found, none, lambda kept, x: F.when(F.exists(kept, lambda y: y.strategy == x.strategy), kept).otherwise(F.concat(kept, F.array(x))))
    last = F.struct(F.lit(999).alias("priority"), (-F.col("est_ratio").cast("double")).alias("_less"), F.lit(FALLBACK).alias("strategy"))
    return F.when(F.exists(found, lambda x: x.strategy == FALLBACK), first).otherwise(F.concat(first, F.array(last)))


def ranked(reports: DataFrame, names: Sequence[str] = REGISTERED) -> DataFrame:
    """(file_id, rank, strategy, priority, est_ratio) of each file's candidates; one scan, no shuffle."""
    each = reports.select("file_id", F.posexplode(ranking(names)).alias("p", "c"))
    return each.select("file_id", (F.col("p") + 1).alias("rank"), "c.strategy", "c.priority", (-F.col("c._less")).alias("est_ratio"))


def within_memory(found: DataFrame, budget_mb: int) -> DataFrame:
    """Candidates whose strategy needs no more than the budget."""
    need = F.lit(MEMORY_DEFAULT_MB)
    for name, mb in MEMORY_MB.items():
        need = F.when(F.col("strategy") == name, mb).otherwise(need)
    return found.withColumn("needs_mb", need).where(F.col("needs_mb") <= budget_mb)


def best_attempt(attempts: DataFrame, excellent: float = 50.0) -> DataFrame:
    """(file_id, strategy, ratio) of the attempt that is kept: the first at or above ``excellent``, else the best; only verified ones count."""
    ratio = F.when(F.col("compressed_size") > 0, F.col("original_size") / F.col("compressed_size")).otherwise(0.0)
    good = attempts.where("error IS NULL AND lossless").withColumn("ratio", ratio)
    pick = F.struct("strategy", "ratio")
    first = F.min_by(pick, F.when(F.col("ratio") >= excellent, F.struct(F.col("ord"), -F.col("ratio"))))
    best = F.max_by(pick, F.struct("ratio", -F.col("ord")))
    chosen = good.groupBy("file_id").agg(F.coalesce(first, best).alias("c"))
    return chosen.select("file_id", "c.strategy", F.round("c.ratio", 6).alias("ratio"))
