"""Components of documents: parts of HTML pages and archives, duplicates, positions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import content as C

#: (type, pattern with one group) of HTML components
HTML = (
    ("metadata", r"(<meta[^>]*>)"),
    ("layout", r"<(?:article|nav|table)[^>]*>()"),
    ("text", r"(?s)<p>(.*?)(?:</p>|<br>|$)"),
    ("link", r'<a href="([^"]*)"'),
    ("image", r'<img[^>]*src="([^"]*)"'),
    ("script", r"(?s)<script[^>]*>(.*?)</script>"),
    ("style", r"(?s)<style[^>]*>(.*?)</style>"),
)


def html_components(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, type, ord, data, hash): what the patterns find, numbered within page and type; blank text is left out, empty data has an empty hash."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(html), F.lit(pattern), 1), lambda d, i: F.struct(F.lit(kind).alias("type"), i.alias("ord"), d.alias("data")))

    parts = F.concat(*[found(k, p) for k, p in HTML])
    rows = pages.where(F.col(html).isNotNull()).select(id_col, F.explode(parts).alias("c")).select(id_col, "c.*")
    rows = rows.where("type <> 'text' OR trim(data) <> ''")
    return rows.withColumn("hash", F.when(F.length("data") > 0, F.sha2("data", 256)).otherwise(""))


def stored_or_reference(parts: DataFrame, id_col: str = "id", order: str = "ord") -> DataFrame:
    """Adds stored: true for the first component with its hash in a document, false for those that refer to it. Empty ones are always stored."""
    first = F.row_number().over(Window.partitionBy(id_col, "hash").orderBy("type", order)) == 1
    return parts.withColumn("stored", first | (F.col("hash") == ""))


def duplicate_map(parts: DataFrame, id_col: str = "id") -> DataFrame:
    """(hash, type, places, n): content that occurs in more than one document."""
    held = parts.where("hash <> ''").groupBy("hash", "type").agg(F.array_sort(F.collect_set(id_col)).alias("places"), F.count(F.lit(1)).alias("n"))
    return held.where(F.size("places") > 1)


def summary(parts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, components, distinct_components, duplicates, raw_bytes, duplicate_bytes)."""
    n = C.size_of(C.utf8(F.col("data")))
    each = parts.groupBy(id_col, "hash").agg(F.count(F.lit(1)).alias("c"), F.sum(n).alias("s"), F.max(n).alias("one"))
    return each.groupBy(id_col).agg(F.sum("c").alias("components"), F.count(F.lit(1)).alias("distinct_components"), F.sum(F.col("c") - 1).alias("duplicates"), F.sum("s").alias("raw_bytes"), F.sum((F.col("c") - 1) * F.col("one")).alias("duplicate_bytes"))


def member_class(path: Column) -> Column:
    """What an archive member is by its name: xml (case counts), media, font or other."""
    low = F.lower(path)
    media = low.rlike(r"\.(png|jpg|jpeg|gif|bmp|tiff|emf|wmf|svg)$")
    return F.when(path.rlike(r"\.(xml|rels)$"), "xml").when(media, "media").when(low.rlike(r"\.(ttf|otf|fntdata|odttf)$"), "font").otherwise("other")


def bbox(matrix: Column) -> Column:
    """[x0, y0, x1, y1] of the unit square under a transformation [a, b, c, d, e, f], at 2 digits."""
    a, d, e, f = (matrix[i] for i in (0, 3, 4, 5))
    return F.array(F.round(e, 2), F.round(f, 2), F.round(e + F.abs(a), 2), F.round(f + F.abs(d), 2))


def placed(elements: DataFrame, pages: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Elements (doc_id, page, type, matrix) with a box: from their matrix, else the whole page, of 612 x 792 if that has no size."""
    sized = elements.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left")
    whole = F.array(F.lit(0.0), F.lit(0.0), F.coalesce("width", F.lit(width)), F.coalesce("height", F.lit(height)))
    return sized.withColumn("bbox", F.coalesce(F.when(F.col("matrix").isNotNull(), bbox(F.col("matrix"))), whole)).drop("width", "height")


def in_order(elements: DataFrame) -> DataFrame:
    """Adds place: the drawing order in a page, by z, then element id."""
    return elements.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("z_order", "element_id")))


def accuracy(placed_n: Column, total: Column) -> Column:
    return F.when((total > 0) & (placed_n == total), "exact").when(placed_n > 0, "approximate").otherwise("page-level")
