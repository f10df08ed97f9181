"""Image, document, residual and streaming queries."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions import content as C
from sparkfold.functions.lineage import cut, shared_folder, spread
from sparkfold.operators import bundles, codecs, components, images, orchestrate, positions, raster, residuals, windows
from sparkfold.sources import archives, pdf
from sparkfold.streaming import ingest

from .common import query, table, values
from .redundancy import _STORE, _WITH, BLOCK

#: Images that are made in SQL: two gradients, one colour, stripes, noise and a step.
_MADE = """SELECT img_id, x, y,
    CASE img_id WHEN 0 THEN {round}(10 + 200 * x / 63{d}) WHEN 1 THEN {round}(5 + 190 * y / 47{d}) WHEN 2 THEN 80 WHEN 3 THEN 255 * (y % 2) WHEN 4 THEN (x * 7919 + y * 104729 + x * y * 31) % 256 ELSE CASE WHEN x < 32 THEN 10 ELSE 240 END END AS r,
    CASE img_id WHEN 0 THEN 100 WHEN 1 THEN {round}(255 - 190 * y / 47{d}) WHEN 2 THEN 90 WHEN 3 THEN 255 * (y % 2) WHEN 4 THEN (x * 104729 + y * 1299709 + x * y * 17) % 256 ELSE 128 END AS g,
    CASE img_id WHEN 0 THEN 150 WHEN 1 THEN 20 WHEN 2 THEN 100 WHEN 3 THEN 255 * (y % 2) WHEN 4 THEN (x * 15485863 + y * 7919 + x * y * 13) % 256 ELSE 30 END AS b"""
_TYPES = "SELECT img_id::INT AS img_id, x::INT AS x, y::INT AS y, r::INT AS r, g::INT AS g, b::INT AS b"
_PX = f"({_TYPES} FROM ({_MADE.format(round='round_even', d='::DOUBLE, 0')} FROM range(0, 6) AS i(img_id), range(0, 64) AS xs(x), range(0, 48) AS ys(y)))"
_GRAY = f"(SELECT *, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS l FROM {_PX})"


def _pixels(spark: SparkSession) -> DataFrame:
    made = spark.range(6 * 64 * 48).select(F.expr("id div 3072").alias("img_id"), F.expr("id % 64").alias("x"), F.expr("id % 3072 div 64").alias("y"))
    sql = _MADE.format(round="bround", d="D")
    px = spark.sql(sql + " FROM {made}", made=made)
    return px.select(*[F.col(c).cast("int") for c in ("img_id", "x", "y", "r", "g", "b")])


@query(f"SELECT * FROM {_PX}")
def gradient_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark)


_ENDS = f"(SELECT img_id, x, y, r, g, b, " + ", ".join(f"max(CASE WHEN {cond} THEN {c} END) OVER (PARTITION BY img_id) AS {n}{c}" for n, cond in (("h0", "y = 24 AND x = 0"), ("h1", "y = 24 AND x = 63"), ("v0", "x = 32 AND y = 0"), ("v1", "x = 32 AND y = 47")) for c in "rgb") + f" FROM {_PX})"
_OFF = {d: "greatest(" + ", ".join(f"abs({c} - round_even({d}0{c} + ({d}1{c} - {d}0{c}) * ({t}), 0))" for c in "rgb") + ")" for d, t in (("h", "x / 63.0::DOUBLE"), ("v", "y / 47.0::DOUBLE"))}


@query(f"SELECT img_id, CASE WHEN h <= 2 THEN 'horizontal' WHEN v <= 2 THEN 'vertical' END AS direction, least(h, v)::BIGINT AS worst, least(h, v) <= 2 AS is_gradient FROM (SELECT img_id, max({_OFF['h']}) AS h, max({_OFF['v']}) AS v FROM {_ENDS} GROUP BY img_id)")
def gradient_lerp_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.linear_gradients(_pixels(spark))


_EDGES = f"(SELECT img_id, round(avg((abs(l - n) > 20)::INT), 6) AS edge_density FROM (SELECT img_id, l, lead(l) OVER (PARTITION BY img_id, y ORDER BY x) AS n FROM {_GRAY}) WHERE n IS NOT NULL GROUP BY img_id)"


@query(f"SELECT * FROM {_EDGES}")
def image_edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.edge_density(_pixels(spark))


def _stripe_sql(along: str, across: str, last: int) -> str:
    return f"(SELECT img_id, round(avg(same), 6) AS score FROM (SELECT img_id, {across}, (sum(abs(l - n)) < 5 * count(*))::INT AS same FROM (SELECT img_id, x, y, l, lead(l) OVER (PARTITION BY img_id, {along} ORDER BY {across}) AS n FROM {_GRAY}) WHERE {across} < {last} GROUP BY img_id, {across}) GROUP BY img_id)"


_H, _V = _stripe_sql("x", "y", 47), _stripe_sql("y", "x", 63)


@query(f"SELECT h.img_id, h.score AS horizontal, v.score AS vertical FROM {_H} h JOIN {_V} v USING (img_id)")
def image_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark)
    return images.stripes(px, "horizontal").withColumnRenamed("score", "horizontal").join(images.stripes(px, "vertical").withColumnRenamed("score", "vertical"), "img_id")


_UNIFORM = f"(SELECT img_id, round(1 - least(1.0::DOUBLE, var_pop(m) / 10000), 6) AS spatial_uniformity FROM (SELECT img_id, x // 16 AS cx, y // 12 AS cy, avg(l) AS m FROM {_GRAY} GROUP BY ALL) GROUP BY img_id)"


@query(f"SELECT * FROM {_UNIFORM}")
def image_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.uniformity(_pixels(spark))


_COLORS = f"(SELECT img_id, count(*) AS palette_size, round(count(*) / sum(c), 6) AS unique_color_ratio, abs(round(-sum(c / 3072.0::DOUBLE * log2(c / 3072.0::DOUBLE)), 6)) AS color_entropy FROM (SELECT img_id, r, g, b, count(*) AS c FROM {_PX} GROUP BY ALL) GROUP BY img_id)"


@query(f"SELECT img_id, palette_size, unique_color_ratio FROM {_COLORS}")
def image_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.palette(_pixels(spark))


@query(f"SELECT img_id, color_entropy FROM {_COLORS}")
def image_color_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.color_entropy(_pixels(spark))


_BRIGHT = f"(SELECT img_id, round((avg(r) + avg(g) + avg(b)) / 3, 6) AS mean_brightness, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 6) AS brightness_std FROM {_PX} GROUP BY img_id)"


@query(f"SELECT * FROM {_BRIGHT}")
def image_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.brightness(_pixels(spark))


_FEATURES = f"(SELECT *, 64 AS w, 48 AS h, greatest(h.score, v.score) AS stripe, img_id % 2 = 1 AS has_transparency, img_id = 4 AS is_grayscale FROM {_COLORS} JOIN {_BRIGHT} USING (img_id) JOIN {_EDGES} USING (img_id) JOIN {_UNIFORM} USING (img_id) JOIN {_H} h USING (img_id) JOIN {_V} v USING (img_id))"
_SCORES = "[" + ", ".join(f"({s})::DOUBLE" for _, s in images.CONTENT) + "]"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in images.CONTENT) + "]"


_CLASSES = f"""WITH f AS (SELECT *, {_SCORES} AS s FROM {_FEATURES}),
    t AS (SELECT *, CASE WHEN stripe > 0.95 AND edge_density < 0.05 THEN 'gradient' WHEN list_sum(s) <= 0 THEN 'unknown' ELSE ({_NAMES})[list_position(s, list_max(s))] END AS content_type,
        round(CASE WHEN stripe > 0.95 AND edge_density < 0.05 THEN 1 WHEN list_sum(s) <= 0 THEN 0 ELSE least(1, list_max(s) / list_sum(s)) END::DOUBLE, 6) AS content_confidence FROM f)
    SELECT img_id, content_type, content_confidence, CASE WHEN content_type = 'screenshot' THEN 'ui' WHEN is_grayscale AND unique_color_ratio > 0.1 THEN 'medical' ELSE 'general' END AS domain,
        round(CASE WHEN content_type = 'screenshot' THEN least(1, 1.5 * stripe) WHEN is_grayscale AND unique_color_ratio > 0.1 THEN 0.45 ELSE 0.9 END::DOUBLE, 6) AS domain_confidence,
        CASE WHEN content_type = 'gradient' THEN 'gradient' WHEN content_type = 'screenshot' THEN 'screenshot' WHEN content_type = 'logo' AND has_transparency THEN 'vector_render' WHEN unique_color_ratio > 0.4 AND color_entropy > 16 THEN 'natural' WHEN unique_color_ratio < 0.001 AND spatial_uniformity > 0.85 THEN 'synthetic' ELSE 'natural' END AS generation,
        CASE WHEN content_type = 'gradient' THEN 0.9 WHEN content_type = 'screenshot' THEN 0.88 WHEN content_type = 'logo' AND has_transparency THEN 0.75 WHEN unique_color_ratio > 0.4 AND color_entropy > 16 THEN 0.85 WHEN unique_color_ratio < 0.001 AND spatial_uniformity > 0.85 THEN 0.7 ELSE 0.55 END::DOUBLE AS generation_confidence FROM t"""


@query(_CLASSES)
def image_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.classify(images.features(_pixels(spark)).withColumns({"has_transparency": F.col("img_id") % 2 == 1, "is_grayscale": F.col("img_id") == 4}))


@query(
    _CLASSES.replace("img_id % 2 = 1 AS has_transparency, img_id = 4 AS is_grayscale", "false AS has_transparency, img_id = 3 AS is_grayscale").replace("WITH f AS", "WITH c AS (WITH f AS")
    + """) SELECT img_id, content_type, content_confidence, array_to_string(list_filter([CASE WHEN generation = 'gradient' AND generation_confidence > 0.8 THEN 'procedural_gradient' END, CASE WHEN content_type = 'screenshot' THEN 'semantic_screenshot' END,
    CASE WHEN content_type = 'logo' THEN 'procedural_vector' END, 'traditional_zstd'], lambda x: x IS NOT NULL), ',') AS hints, CASE WHEN content_type = 'gradient' AND content_confidence > 0.7 THEN 'procedural_gradient,traditional_zstd' ELSE 'traditional_zstd' END AS strategies FROM c"""
)
def image_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files all the way through the analysis: their class, hints and ranked strategies."""
    rows = orchestrate.analyse(_image_files(spark).withColumn("path", F.format_string("i%d.png", "img_id")))
    return rows.select("img_id", "content_type", "content_confidence", F.array_join("hints", ",").alias("hints"), F.array_join(orchestrate.strategies(), ",").alias("strategies"))


@query(f"SELECT img_id, round(mse, 6) AS mse, CASE WHEN mse > 0 THEN round(20 * log10(255 / sqrt(mse)), 6) END AS psnr FROM (SELECT img_id, avg((r % 16) * (r % 16) * (img_id > 0)::INT + (g % 16) * (g % 16) * (img_id > 0)::INT + (b % 16) * (b % 16) * (img_id > 0)::INT) / 3 AS mse FROM {_PX} GROUP BY img_id)")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image but the first against itself at 16 levels."""
    px = _pixels(spark)
    coarse = px.select("img_id", "x", "y", *[F.when(F.col("img_id") > 0, F.col(c) - F.col(c) % 16).otherwise(F.col(c)).alias(c) for c in "rgb"])
    return images.psnr(px, coarse)


_FLAT = "(SELECT vec_id, list_transform(embedding, lambda e: least(255, greatest(0, floor(e::DOUBLE * 128 + 128)))::INT) AS v FROM embeddings)"


@query(f"SELECT vec_id, sha256(unhex(array_to_string(list_transform(v, lambda b: printf('%02X', b)), ''))) AS restored_hash, len(v) AS n, round(list_sum(list_transform(v, lambda b: b % 16)) / len(v)::DOUBLE, 6) AS mean_residual FROM {_FLAT}")
def residual_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes through a codec that keeps sixteen levels, made whole by its differences; and how much those are on average."""
    there, back = residuals.codec(_sixteenths, _widened)
    flat = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 128 + 128).cast("int"))))
    v = table(spark, sf_dir, "embeddings").select("vec_id", flat.alias("v"), F.unhex(F.array_join(F.transform(flat, lambda b: F.lpad(F.hex(b), 2, "0")), "")).alias("bytes"))
    coded = v.withColumn("c", there("bytes"))
    coarse = F.transform("v", lambda b: b - b % 16)
    return coded.select("vec_id", F.sha2(back("c.latent", "c.difference"), 256).alias("restored_hash"), F.size("v").cast("long").alias("n"), residuals.mean_residual(F.col("v"), coarse).alias("mean_residual"))


def _sixteenths(values):
    return (values // 16).astype("uint8").tobytes()


def _widened(latent):
    import numpy as np

    return np.frombuffer(latent, np.uint8) * np.uint8(16)


#: The images as files and back: their pixels in reading order as hex.
_HEX = "string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x)"


def _image_files(spark: SparkSession) -> DataFrame:
    """(img_id, content): the images as PNG files."""
    kind = T.StructType.fromDDL("img_id int, content binary")

    def draw(table_: pa.Table) -> pa.Table:
        t = table_.sort_by([("y", "ascending"), ("x", "ascending")])
        px = np.stack([t.column(c).to_numpy() for c in "rgb"], 1).astype(np.uint8).reshape(48, 64, 3)
        return pa.table({"img_id": t.column("img_id").slice(0, 1), "content": pa.array([raster.write("PNG", px)], pa.binary())})

    return _pixels(spark).groupBy("img_id").applyInArrow(draw, kind)


@F.arrow_udf(T.StringType())
def _pixel_hash(content: pa.Array) -> pa.Array:
    """The hash of an image file's pixels."""
    return pa.array([hashlib.sha256(raster.read(v.as_py())[1].tobytes()).hexdigest() if v.is_valid else None for v in content], pa.string())


@query(f"SELECT img_id, img_id IN (0, 1, 2) AS accepted, sha256(unhex({_HEX})) AS pixel_hash, CASE WHEN img_id > 2 THEN 'Unsuitable: not a linear gradient' END AS error, CASE WHEN img_id <= 2 THEN 'pixels' END AS verified FROM {_PX} GROUP BY img_id")
def gradient_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as PNG files through the gradient codec: the pixels that come back, or why it refuses them."""
    files_ = _image_files(spark)
    tries = codecs.attempts(files_, ["procedural_gradient"], "img_id", keep_packed=True).withColumnRenamed("file_id", "img_id")
    both = files_.join(tries, "img_id").withColumn("back", F.coalesce(codecs.decompressor("procedural_gradient")("packed"), "content"))
    return both.select("img_id", F.col("lossless").alias("accepted"), _pixel_hash("back").alias("pixel_hash"), "error", F.when(F.col("verified").isNotNull(), "pixels").alias("verified"))


def _office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): documents as office archives; a media part occurs twice."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    names = F.array(*map(F.lit, ("[Content_Types].xml", "word/document.xml", "word/media/a.bin", "word/media/b.bin", "docProps/app.xml")))
    media = C.utf8(F.repeat(F.col("lang"), 40))
    parts = F.array(C.utf8(F.lit("<Types/>")), C.utf8(F.col("text")), media, media, C.utf8(F.concat(F.lit("<p>"), F.col("source"), F.lit("</p>"))))
    return docs.select("doc_id", archives.zip_of(names, parts).alias("content"))


@query("SELECT doc_id, path, sha256(encode(data)) AS member_hash, octet_length(encode(data)) AS size FROM (SELECT doc_id, unnest(['[Content_Types].xml', 'word/document.xml', 'word/media/a.bin', 'word/media/b.bin', 'docProps/app.xml']) AS path, unnest(['<Types/>', text, repeat(lang, 40), repeat(lang, 40), '<p>' || source || '</p>']) AS data FROM documents)")
def office_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office archives through the bundle codec: every member of what comes back."""
    packed = _office_files(spark, sf_dir).select("doc_id", codecs.compressor("semantic_office")("content").alias("p"))
    back = packed.select(F.col("doc_id").alias("id"), codecs.decompressor("semantic_office")("p").alias("content"))
    return archives.zip_components(back).select(F.col("id").alias("doc_id"), "path", F.sha2("data", 256).alias("member_hash"), C.size_of(F.col("data")).alias("size"))


@query("SELECT doc_id, 'f' || doc_id || '.bin' AS path, 'DOCX' AS format_type, 'document' AS category, 'semantic_office,traditional_zstd' AS hints FROM documents")
def office_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analysis of files says of office archives without a telling name."""
    some = _office_files(spark, sf_dir).withColumn("path", F.format_string("f%d.bin", "doc_id"))
    return orchestrate.analyse(some).select("doc_id", "path", "format_type", "category", F.array_join("hints", ",").alias("hints"))


def _component_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT page_id, '{k}' AS type, generate_subscripts(m, 1) - 1 AS ord, unnest(m) AS data FROM (SELECT page_id, regexp_extract_all(html, '{p}', 1) AS m FROM pages)" for k, p in components.HTML)
    return f"(SELECT page_id, type, ord::INT AS ord, data, CASE WHEN data <> '' THEN sha256(data) ELSE '' END AS hash FROM ({parts}) WHERE type <> 'text' OR trim(data, ' ') <> '')"


_PARTS = _component_sql()


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.html_components(table(spark, sf_dir, "pages"))


@query(f"SELECT * FROM {_PARTS}")
def page_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


@query(f"SELECT page_id, type, ord, hash = '' OR row_number() OVER (PARTITION BY page_id, hash ORDER BY type, ord) = 1 AS stored FROM {_PARTS}")
def component_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.stored_or_reference(_parts(spark, sf_dir), "page_id").select("page_id", "type", "ord", "stored")


@query(f"SELECT hash, type, array_to_string(list_sort(list(DISTINCT page_id)), ',') AS places, count(*) AS n FROM {_PARTS} WHERE hash <> '' GROUP BY hash, type HAVING count(DISTINCT page_id) > 1")
def duplicate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.duplicate_map(_parts(spark, sf_dir), "page_id").withColumn("places", F.array_join("places", ","))


@query(f"SELECT page_id, sum(c)::BIGINT AS components, count(*) AS distinct_components, sum(c - 1)::BIGINT AS duplicates, sum(s)::BIGINT AS raw_bytes, sum((c - 1) * one)::BIGINT AS duplicate_bytes FROM (SELECT page_id, hash, count(*) AS c, sum(octet_length(encode(data))) AS s, max(octet_length(encode(data))) AS one FROM {_PARTS} GROUP BY ALL) GROUP BY page_id")
def doc_component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.summary(_parts(spark, sf_dir), "page_id")


_MEMBERS = [(i, p) for i, p in enumerate(["[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/media/image1.PNG", "ppt/fonts/f.fntdata", "a.TTF", "X.XML", "docProps/thumb.jpeg", "xl/vba.bin", "noext", "m.emf", "a.xml.bak"])]


@query(f"SELECT i, path, CASE WHEN path LIKE '%.xml' OR path LIKE '%.rels' THEN 'xml' WHEN regexp_matches(lower(path), '\\.(png|jpg|jpeg|gif|bmp|tiff|emf|wmf|svg)$') THEN 'media' WHEN regexp_matches(lower(path), '\\.(ttf|otf|fntdata|odttf)$') THEN 'font' ELSE 'other' END AS class FROM {values(_MEMBERS, 'i, path')}")
def office_member_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_MEMBERS, "i int, path string").select("i", "path", components.member_class(F.col("path")).alias("class"))


#: One element for each line item: its matrix, or none, from the item's numbers.
_ELEMENTS = "(SELECT l_orderkey AS doc_id, l_suppkey % 3 AS page, l_partkey * 10 + l_linenumber AS element_id, CASE WHEN l_linenumber % 4 = 0 THEN 'text' ELSE 'image' END AS type, CASE WHEN l_linenumber % 4 = 0 THEN 100 ELSE l_linenumber END AS z_order, l_quantity AS a, -l_discount * 100 AS d, l_tax * 1000 AS e, l_extendedprice AS f FROM lineitem)"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_suppkey % 3 AS page", "l_partkey * 10 + l_linenumber AS element_id", "CASE WHEN l_linenumber % 4 = 0 THEN 'text' ELSE 'image' END AS type", "CASE WHEN l_linenumber % 4 = 0 THEN 100 ELSE l_linenumber END AS z_order", "l_quantity AS a", "-l_discount * 100 AS d", "l_tax * 1000 AS e", "l_extendedprice AS f")
    return rows.withColumn("matrix", F.when(F.col("type") == "image", F.array("a", F.lit(0.0), F.lit(0.0), "d", "e", "f"))).drop("a", "d", "e", "f")


#: Sizes of pages, known of two thirds of them.
_SIZES = "(SELECT DISTINCT doc_id, page, 300.0::DOUBLE + doc_id % 400 AS width, 500.0::DOUBLE + page * 50 AS height FROM {} WHERE (doc_id + page) % 3 > 0)"


@query(f"SELECT e.doc_id, e.page, element_id, CASE WHEN type = 'image' THEN round(e, 2) ELSE 0 END AS x0, CASE WHEN type = 'image' THEN round(f, 2) ELSE 0 END AS y0, CASE WHEN type = 'image' THEN round(e + abs(a), 2) ELSE coalesce(width, 612) END AS x1, CASE WHEN type = 'image' THEN round(f + abs(d), 2) ELSE coalesce(height, 792) END AS y1 FROM {_ELEMENTS} e LEFT JOIN {_SIZES.format(_ELEMENTS)} p ON p.doc_id = e.doc_id AND p.page = e.page")
def element_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each element: by its matrix, else its page's, else that of a page without a size."""
    e = _elements(spark, sf_dir)
    sizes = e.where((F.col("doc_id") + F.col("page")) % 3 > 0).select("doc_id", "page").distinct().select("doc_id", "page", (F.lit(300.0) + F.col("doc_id") % 400).alias("width"), (F.lit(500.0) + F.col("page") * 50).alias("height"))
    box = components.placed(e, sizes)
    return box.select("doc_id", "page", "element_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


#: PDF files made of the pages table: one to three pages, on each one image placed by numbers of the ids, and some text.
_PDF = "(SELECT page_id AS id, p::INT AS page, 400.0::DOUBLE + page_id % 200 AS width, 600.0::DOUBLE + p * 10 AS height, 90 * (p % 4) AS rotation, 'page ' || p || ' of ' || url AS t, 4 + page_id % 5 AS w, 3 + p AS h, ['40', 'A0', 'F0'][1 + page_id % 3] AS b, page_id % 90 + 0.25::DOUBLE AS x, p * 7 + 0.5::DOUBLE AS y, 20 + page_id % 30 AS sx, 30 + p AS sy FROM pages, LATERAL (SELECT unnest(range(1, page_id % 3 + 2)) AS p))"


def _pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content): the files of _PDF, written by the library's own writer."""

    @F.arrow_udf("binary")
    def make(ids: pa.Array, urls: pa.Array) -> pa.Array:
        out = []
        for i, url in zip(ids.to_pylist(), urls.to_pylist(), strict=True):
            made = []
            for p in range(1, i % 3 + 2):
                w, h, x, y = 4 + i % 5, 3 + p, i % 90 + 0.25, p * 7 + 0.5
                image = pdf.Element("image", [x, y, x + 20 + i % 30, y + 30 + p], 0, bytes([(0x40, 0xA0, 0xF0)[i % 3]]) * (w * h), f"Im{p}", w, h)
                made.append(pdf.Page(p, 400 + i % 200, 600 + p * 10, 90 * (p % 4), [image, pdf.Element("text", [0, 0, 1, 1], 100, f"page {p} of {url}".encode())]))
            out.append(pdf.write(made)[0])
        return pa.array(out, pa.binary())

    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), make("page_id", "url").alias("content"))


_IMAGE_HASH, _TEXT_HASH = "sha256(unhex(repeat(b, (w * h)::INT)))", "sha256(encode(t))"
_PDF_ELEMENTS = f"(SELECT id, page, 'image' AS type, 0 AS z_order, 'Im' || page AS name, x AS x0, y AS y0, round(x + sx, 2) AS x1, round(y + sy, 2) AS y1, w::DOUBLE AS width, h::DOUBLE AS height, {_IMAGE_HASH} AS hash FROM {_PDF} UNION ALL SELECT id, page, 'text', 100, NULL, 0, 0, width, height, 0, 0, {_TEXT_HASH} FROM {_PDF})"


@query(f"SELECT *, round(x1 - x0, 2) AS extent_x, round(y1 - y0, 2) AS extent_y FROM {_PDF_ELEMENTS}")
def pdf_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of PDF files with its place and content hash."""
    x, y = positions.extent()
    return positions.elements(positions.layout(_pdf_files(spark, sf_dir))).select("*", x.alias("extent_x"), y.alias("extent_y"))


@query(f"SELECT id, sum(n)::BIGINT AS parts, count(*) AS page_count, count(*) FILTER (WHERE r > 1) AS repeated, string_agg(h, '' ORDER BY page) AS image_hashes FROM (SELECT id, page, 2 AS n, {_IMAGE_HASH} AS h, row_number() OVER (PARTITION BY id, w * h ORDER BY page) AS r FROM {_PDF}) GROUP BY id")
def pdf_bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of PDF files through a bundle that stores equal ones once."""

    @F.arrow_udf("struct<parts:bigint,page_count:bigint,repeated:bigint,image_hashes:string>")
    def through(content: pa.Array) -> pa.Array:
        out = []
        for v in content.to_pylist():
            parts = [{"path": name, "type": kind, "data": data} for name, kind, data in archives.pdf_parts(v)]
            form, back = bundles.unpack(bundles.pack("PDF", parts))
            images_ = [hashlib.sha256(p["data"]).hexdigest() for p in back if p["type"] == "image"]
            out.append({"parts": sum(p["type"] in ("image", "text") for p in back), "page_count": sum(p["type"] == "layout" for p in back), "repeated": sum(p["codec"] == "reference" and p["type"] == "image" for p in back), "image_hashes": "".join(images_)})
        return pa.array(out, pa.struct([("parts", pa.int64()), ("page_count", pa.int64()), ("repeated", pa.int64()), ("image_hashes", pa.string())]))

    return _pdf_files(spark, sf_dir).select("id", through("content").alias("b")).select("id", "b.*")


@query(f"SELECT id, string_agg({_TEXT_HASH}, '' ORDER BY page) AS text_hashes, true AS lossless FROM {_PDF} GROUP BY id")
def pdf_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files through the lossless codec, and the texts of what comes back."""
    files_ = cut(_pdf_files(spark, sf_dir))
    packed = files_.select("id", F.col("content").alias("original"), codecs.compressor("semantic_pdf")("content").alias("p"))
    back = cut(packed.select("id", codecs.decompressor("semantic_pdf")("p").alias("content"), "original"))
    texts = positions.elements(positions.layout(back), "text").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "hash"))), lambda x: x.hash), "").alias("text_hashes"))
    return texts.join(back, "id").select("id", "text_hashes", (F.col("content") == F.col("original")).alias("lossless"))


@query(f"SELECT id, count(*)::INT AS page_count, count(*) AS images_total, (count(*) - max(gone))::BIGINT AS images_placed, CASE WHEN max(gone) = 0 THEN 'exact' WHEN count(*) > max(gone) THEN 'approximate' ELSE 'page-level' END AS accuracy, max(note) AS notes, sum(width)::DOUBLE AS widths, sum(height)::DOUBLE AS heights FROM (SELECT *, (page = 1 AND id % 4 = 0)::INT AS gone, CASE WHEN page = 1 AND id % 4 = 0 THEN 'page 1: image ' || substr({_IMAGE_HASH}, 1, 8) || ' is not in the store' END AS note FROM {_PDF}) GROUP BY id")
def pdf_reconstruct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files made again from bundles and a store that lacks the first image of every fourth file, and the pages of what was made."""
    rows = cut(positions.layout(_pdf_files(spark, sf_dir)))
    keyed = rows.withColumn("hash", F.when((F.col("type") == "image") & (F.col("page") == 1) & (F.col("id") % 4 == 0), F.concat(F.col("hash"), F.lit("-gone"))).otherwise(F.col("hash")))
    made = cut(positions.reconstruct(positions.unbundle(positions.bundle(keyed)), positions.contents(rows)))
    again = positions.page_sizes(positions.layout(made, "id", "pdf")).groupBy("id").agg(F.sum("width").alias("widths"), F.sum("height").alias("heights"))
    return made.join(again, "id").select("id", "page_count", "images_total", "images_placed", "accuracy", F.when(F.size("notes") > 0, F.array_join("notes", "; ")).alias("notes"), "widths", "heights")


@query(f"SELECT id, page, type, z_order, hash, 'page ' || page || ': ' || type || ' ' || substr(hash, 1, 8) || ' is not in the store' AS note FROM {_PDF_ELEMENTS} WHERE type = 'text' UNION ALL SELECT id, page, type, z_order, hash, NULL FROM {_PDF_ELEMENTS} WHERE type = 'image'")
def pdf_content_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements against a store of images only."""
    rows = cut(positions.layout(_pdf_files(spark, sf_dir)))
    found = positions.with_content(positions.elements(rows), positions.contents(rows.where("type = 'image'")))
    return found.select("id", "page", "type", "z_order", "hash", "note")


@query(f"SELECT doc_id, page, element_id, (row_number() OVER (PARTITION BY doc_id, page ORDER BY z_order, element_id))::INT AS place FROM {_ELEMENTS}")
def zorder_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.in_order(_elements(spark, sf_dir)).select("doc_id", "page", "element_id", "place")


@query(f"SELECT doc_id, count(*) AS total, sum((type = 'image')::INT)::BIGINT AS placed, CASE WHEN sum((type = 'image')::INT) = count(*) THEN 'exact' WHEN sum((type = 'image')::INT) > 0 THEN 'approximate' ELSE 'page-level' END AS accuracy FROM {_ELEMENTS} GROUP BY doc_id")
def placement_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _elements(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count("matrix").alias("placed"))
    return n.withColumn("accuracy", components.accuracy(F.col("placed"), F.col("total")))


#: Micro-batches that the streams below take their files in, at most: each is held against all before it, so one for every file would cost their number squared.
MICRO_BATCHES = 4


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    docs = table(spark, sf_dir, "documents")
    path = f"{sf_dir}/documents.parquet" if len(docs.inputFiles()) > 1 else f"{sf_dir}/documents*.parquet"
    files = -(-len(docs.inputFiles()) // MICRO_BATCHES)
    return ingest.content_stream(spark, path, docs.schema, files=files), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(f"SELECT * FROM {_STORE}")
def stream_cas_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks ingested as a stream give the same store as the batch query."""
    stream, folder = _stream(spark, sf_dir)
    ingest.ingest_blocks(stream, folder, BLOCK).awaitTermination()
    return ingest.read_store(spark, folder)


@query("SELECT doc_id, octet_length(encode(text)) AS original_size, sha256(encode(text)) AS restored_hash FROM documents WHERE length(text) > 0")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a stream stored, joined again."""
    stream, folder = _stream(spark, sf_dir)
    ingest.ingest_windows(stream, folder, 4096, level=3).awaitTermination()
    back = windows.restore(ingest.read_windows(spark, folder), "doc_id")
    return back.select("doc_id", C.size_of(F.col("content")).alias("original_size"), F.sha2("content", 256).alias("restored_hash"))


@query(f"{_WITH} SELECT a, b, jaccard FROM pairs")
def stream_lsh_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _stream(spark, sf_dir)
    ingest.ingest_signatures(stream, folder).awaitTermination()
    least = ingest.read_members(spark, folder).groupBy("head").agg(F.min("id").alias("least"))  # the first to come isn't always the smallest id
    pairs = ingest.read_pairs(spark, folder).join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows of events."""
    return ingest.event_counts(table(spark, sf_dir, "events"), "1 hour")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, range(0, 2) AS t(k) GROUP BY ALL")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: windows of an hour every half hour."""
    return ingest.event_counts(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: runs of a user's events less than half an hour apart."""
    return ingest.sessions(table(spark, sf_dir, "events"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)")
def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a cube over line items."""
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("quantity"))


@query("SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name")
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: revenue by nation over the star schema."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(t["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT source, lang, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS n_bytes, count(DISTINCT text) AS texts FROM documents GROUP BY source, lang")
def doc_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(C.size_of(C.utf8(F.col("text")))).alias("n_bytes"), F.countDistinct("text").alias("texts"))


