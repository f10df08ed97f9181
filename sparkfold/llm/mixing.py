"""Mixing sources to target weights by Pareto order sampling.

Every document i of source s has an expected number of copies
``e_i = T_s * g_i / G_s``: T_s is the source's whole number of documents in the
mixture, g_i the document's size measure and G_s its sum. ``floor(e_i)`` copies are
certain; the fraction ``p_i`` is the probability of one more. Of each source the
documents with the smallest Pareto rank ``(u/(1-u)) / (p/(1-p))`` are taken until
exactly T_s copies are there, u being a uniform number derived from the row itself.

Ranks are cut without a global sort: they are counted in BINS bins per source, the
bin with the cut is found from these counts, and only that bin is ordered. What is
broadcast is one row for each source, after its size is checked; text is never
shuffled.

Defined results
    * null source: a source of its own.
    * no source with a positive weight: an empty mixture.
    * null id or text: hashed like an empty string; null and empty texts have the
      smallest measure and can still be drawn.
    * repeated rows (same source, id and text): each is a unit of the draw with a random
      number of its own, so a source has exactly its size. They count as one document,
      which stands in the mixture as often as all its units were drawn; of rows that
      differ in other columns the one that sorts first as JSON is taken.
    * ties between units: by id, text hash and number of the repetition.
    * weights of sources that ``docs`` doesn't have: left out; the shares of the others
      are scaled to 1.
    * empty table: an empty result of the same schema.
    * extra columns, whatever they are called, are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, hash60, of, sized, wrapped

BINS = 1 << 16
SEED = "mix-1"
#: Repetitions of a row that one task makes at a time.
CHUNK = 4096


def _targets(rows: DataFrame, weights: Mapping[str, float] | None, temperature: float, size: int | None) -> DataFrame:
    """(_source, _g_all, _t): measure and whole target of each source, by largest remainders."""
    counts = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"), F.sum("_g").alias("_g_all"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    every = Window.partitionBy()
    total = F.sum("_n").over(every) if size is None else F.lit(size).cast("long")
    share = F.round(F.try_divide(F.col("_w"), F.sum("_w").over(every)), 12)
    quota = counts.withColumn("_w", weight).withColumn("_total", total).withColumn("_quota", F.coalesce(F.round(share * F.col("_total"), 6), F.lit(0.0)))
    quota = quota.withColumn("_t", F.floor("_quota").cast("long")).withColumn("_left", F.when(F.sum("_w").over(every) > 0, F.col("_total") - F.sum("_t").over(every)).otherwise(F.lit(0)))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_quota") - F.col("_t"), 6)), F.col("_source").asc_nulls_last()))
    return quota.withColumn("_place", place).select("_source", "_g_all", (F.col("_t") + F.when((F.col("_place") <= F.col("_left")) & (F.col("_w") > 0), 1).otherwise(0)).alias("_t"))


def sample(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    size: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: bool = True,
) -> DataFrame:
    """The mixture: rows of ``docs``, each as often as it was drawn.

    weights: target share of each source; without it the shares are the sources'
    counts to the power ``temperature``, scaled to 1. size: documents in the
    mixture, without it as many as ``docs`` has. With ``carry`` the columns of
    ``docs`` are returned, otherwise (doc_id, source, copies), one row for each
    document that is drawn. The measure is round(1000 ln(2 + characters)): longer
    documents are likelier, far less than in proportion.
    """
    name = of(docs, source).cast("string")
    measure = F.round(F.lit(1000.0) * F.log(F.lit(2.0) + F.coalesce(F.length(of(docs, text)), F.lit(0)))).cast("long")
    cols = {"_id": of(docs, doc_id), "_source": name, "_g": measure, "_m": F.md5(F.coalesce(of(docs, text), F.lit("")))}
    rows = wrapped(docs, **cols) if carry else docs.select(*[c.alias(k) for k, c in cols.items()])
    rows = rows.withColumn("_h", F.xxhash64("_source", "_id", "_m"))
    targets = sized(cut(_targets(docs.select(name.alias("_source"), measure.alias("_g")), weights, temperature, size))).withColumnRenamed("_source", "_s")
    names = ["_source", "_id", "_m"]
    u = (hash60(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_m"), F.when(F.col("_j") > 0, F.col("_j").cast("string")))) + 0.5) / float(1 << 60)
    p = (F.col("_t") * F.col("_g") % F.col("_g_all")) / F.col("_g_all").cast("double")

    def ranked(df: DataFrame) -> DataFrame:
        df = df.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        df = df.withColumn("_sure", F.expr("(_t * _g) div _g_all")).withColumn("_u", u).withColumn("_p", p)
        q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
        df = df.withColumn("_q", F.when(F.col("_p") > 0, q))
        return df.withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS).cast("int"))

    # repeated rows: found by a hash alone, then counted; rows that merely share it are groups of one
    light = rows.select(*names, "_g", "_h")
    again = sized(cut(light.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")))
    once = light.join(again, "_h", "left_anti").withColumn("_j", F.lit(0).cast("long"))
    units = cut(_units(light.join(again, "_h", "left_semi").groupBy(*names, "_g", "_h").agg(F.count(F.lit(1)).alias("_n"))))
    every = ranked(once.unionByName(units))
    bins = every.groupBy("_source", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("_sure").alias("_sures"), F.max("_t").alias("_t"))
    whole = Window.partitionBy("_source")
    before = F.sum(F.when(F.col("_bin").isNotNull(), F.col("_n")).otherwise(0)).over(whole.orderBy(F.col("_bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("_need", F.col("_t") - F.sum("_sures").over(whole)).withColumn("_before", F.coalesce(before, F.lit(0)))
    # the bin in which a source's fractional copies run out, and how many it still gives
    edge = cut(bins.where("_bin is not null and _need > _before and _need <= _before + _n").select(F.col("_source").alias("_s"), F.col("_bin").alias("_cut"), (F.col("_need") - F.col("_before")).alias("_give")))
    at_edge = every.join(sized(edge), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_cut")))
    key = F.struct("_q", F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("i"), "_m", "_j")
    at_edge = at_edge.withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy(key))).where(F.col("_r") == F.col("_give"))
    last = sized(cut(at_edge.select("_s", key.alias("_last"))))

    def drawn(df: DataFrame) -> DataFrame:
        df = ranked(df).join(last, F.col("_source").eqNullSafe(F.col("_s")), "left")
        more = F.when(F.col("_q").isNotNull() & F.col("_last").isNotNull() & (key <= F.col("_last")), 1).otherwise(0)
        return df.withColumn("_copies", F.col("_sure") + more).where("_copies > 0")

    many = cut(drawn(units).groupBy(*names, "_h").agg(F.sum("_copies").alias("_copies")))
    if not carry:
        found = drawn(once).select(*names, "_copies").unionByName(many.select(*names, "_copies"))
        return found.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_copies").cast("long").alias("copies"))
    alone = drawn(rows.join(again, "_h", "left_anti").withColumn("_j", F.lit(0).cast("long"))).select("_row", "_h", "_copies")
    # of a repeated row the rank limit leaves one in each partition before the shuffle
    order = Window.partitionBy("_h", *names).orderBy(F.to_json("_row"))
    one = rows.join(again, "_h", "left_semi").select("_row", "_h", *names).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    held = many.select(*[F.col(c).alias(f"{c}2") for c in (*names, "_h")], "_copies")
    met = (F.col("_h") == F.col("_h2")) & F.col("_source").eqNullSafe(F.col("_source2")) & F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_m") == F.col("_m2"))
    both = alone.unionByName(one.join(held, met).select("_row", "_h", "_copies"))
    # more than CHUNK copies of a row are written by several tasks
    parts = both.where(F.col("_copies") > CHUNK).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {CHUNK}"))))
    parts = parts.repartition("_h", "_c").select("_row", "_h", F.least(F.lit(CHUNK).cast("long"), F.col("_copies") - F.col("_c") * CHUNK).alias("_copies"))
    out = both.where(F.col("_copies") <= CHUNK).unionByName(parts)
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def _units(counted: DataFrame) -> DataFrame:
    """A row for each of the _n repetitions of a document, numbered by _j; long runs are made by several tasks."""
    chunks = counted.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {CHUNK}"))))
    chunks = chunks.repartition("_h", "_c").withColumn("_to", F.least(F.col("_n"), (F.col("_c") + 1) * CHUNK) - 1)
    return chunks.withColumn("_j", F.explode(F.sequence(F.col("_c") * CHUNK, F.col("_to")))).select("_source", "_id", "_m", "_g", "_h", "_j")
