"""Image measures over a pixel table (img_id, x, y, r, g, b), gradients, and rule-based classification.

``pixels`` makes that table from Spark's ``image`` source. All measures group by image
and, where they need neighbours, by image and line, so one large image is many groups.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import raster

MAX_PIXELS, MAX_LINES, LINE_SAMPLES, EDGE_ROWS = 50_000, 200, 50, 100
EDGE, STRIPE, NEIGHBOUR, TOLERANCE = 20, 5, 4, 2


def pixels(images: DataFrame) -> DataFrame:
    """(img_id, x, y, r, g, b) of ``spark.read.format("image")`` rows; the source's bytes are blue, green, red."""
    i = F.col("image")
    at = images.select(i["origin"].alias("img_id"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("d"), F.explode(F.sequence(F.lit(0), i["width"] * i["height"] - 1)).alias("p"))

    def channel(k: int) -> Column:
        offset = F.col("p") * F.col("n") + F.when(F.col("n") == 1, 0).otherwise(k) + 1
        return F.conv(F.hex(F.substring("d", offset, F.lit(1))), 16, 10).cast("int")

    return at.select("img_id", (F.col("p") % F.col("w")).alias("x"), F.expr("p div w").cast("int").alias("y"), channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def gray() -> Column:
    """Luma as whole numbers."""
    return F.expr("shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)")


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _with_size(px: DataFrame) -> DataFrame:
    """Pixels with their image's width and height; one row an image, so the join is left to the planner."""
    return px.join(sizes(px), "img_id")


def _color_counts(px: DataFrame) -> DataFrame:
    """(img_id, r, g, b, c) over every k-th pixel in reading order."""
    step = F.greatest(F.expr(f"w * h div {MAX_PIXELS}"), F.lit(1))
    sampled = _with_size(px).where((F.col("y") * F.col("w") + F.col("x")) % step == 0)
    return sampled.groupBy("img_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("c"))


def palette(px: DataFrame) -> DataFrame:
    """(img_id, palette_size, unique_color_ratio)."""
    return _color_counts(px).groupBy("img_id").agg(F.count(F.lit(1)).alias("palette_size"), F.round(F.count(F.lit(1)) / F.sum("c"), 6).alias("unique_color_ratio"))


def color_entropy(px: DataFrame) -> DataFrame:
    """(img_id, color_entropy) in bits: log2 n - sum(c log2 c) / n."""
    e = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    return _color_counts(px).groupBy("img_id").agg(F.round(F.abs(e), 6).alias("color_entropy"))


def brightness(px: DataFrame) -> DataFrame:
    """(img_id, mean_brightness, brightness_std): means over the channels."""
    mean, std = (F.round((f("r") + f("g") + f("b")) / 3, 6) for f in (F.avg, F.stddev_pop))
    return px.groupBy("img_id").agg(mean.alias("mean_brightness"), std.alias("brightness_std"))


def edge_density(px: DataFrame) -> DataFrame:
    """(img_id, edge_density): the share of neighbours in sampled rows whose luma differs by more than EDGE."""
    step = F.greatest(F.expr(f"h div {EDGE_ROWS}"), F.lit(1))
    rows = _with_size(px).where(F.col("y") % step == 0).withColumn("l", gray())
    pairs = rows.withColumn("d", F.abs(F.col("l") - F.lag("l").over(Window.partitionBy("img_id", "y").orderBy("x"))))
    return pairs.groupBy("img_id").agg(F.round(F.coalesce(F.try_divide(F.count(F.when(F.col("d") > EDGE, 1)), F.count("d")), F.lit(0.0)), 6).alias("edge_density"))


def uniformity(px: DataFrame) -> DataFrame:
    """(img_id, spatial_uniformity): 1 less the variance of 4 x 4 block means; pixels beyond whole blocks don't count."""
    cell = _with_size(px).withColumn("cx", F.expr("x div greatest(w div 4, 1)")).withColumn("cy", F.expr("y div greatest(h div 4, 1)")).where("cx < 4 AND cy < 4")
    means = cell.groupBy("img_id", "cx", "cy").agg(F.avg(gray()).alias("m"))
    return means.groupBy("img_id").agg(F.round(1 - F.least(F.lit(1.0), F.var_pop("m") / 10_000), 6).alias("spatial_uniformity"))


def stripes(px: DataFrame, axis: str) -> DataFrame:
    """(img_id, score): the share of sampled lines that are much like the next one; 0 for images of one line."""
    along, across, length, lines = ("x", "y", "w", "h") if axis == "horizontal" else ("y", "x", "h", "w")
    gap = F.greatest(F.expr(f"{length} div {LINE_SAMPLES}"), F.lit(1))
    step = F.greatest(F.expr(f"{lines} div greatest(least({lines} - 1, {MAX_LINES}), 1)"), F.lit(1))
    at = _with_size(px).where(F.col(along) % gap == 0).withColumn("l", gray()).withColumn("_step", step)
    nxt = at.withColumn("n", F.lead("l").over(Window.partitionBy("img_id", along).orderBy(across)))
    line = nxt.where((F.col(across) % F.col("_step") == 0) & (F.col(across) < F.col(lines) - 1)).groupBy("img_id", across).agg((F.sum(F.abs(F.col("l") - F.col("n"))) < STRIPE * F.count(F.lit(1))).alias("same"))
    score = line.groupBy("img_id").agg(F.round(F.avg(F.col("same").cast("int")), 6).alias("score"))
    return sizes(px).select("img_id").join(score, "img_id", "left").select("img_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def features(px: DataFrame) -> DataFrame:
    """All measures of each image in one row."""
    out = sizes(px)
    for part in (brightness(px), palette(px), color_entropy(px), edge_density(px), uniformity(px), stripes(px, "horizontal").withColumnRenamed("score", "horizontal_stripe_score"), stripes(px, "vertical").withColumnRenamed("score", "vertical_stripe_score")):
        out = out.join(part, "img_id")
    return out


MEASURES = ("w", "h", "mean_brightness", "brightness_std", "palette_size", "unique_color_ratio", "color_entropy", "edge_density", "spatial_uniformity", "horizontal_stripe_score", "vertical_stripe_score", "has_transparency", "is_grayscale")
_KINDS = {"w": T.IntegerType(), "h": T.IntegerType(), "palette_size": T.LongType(), "has_transparency": T.BooleanType(), "is_grayscale": T.BooleanType()}
FEATURES = T.StructType([T.StructField(m, _KINDS.get(m, T.DoubleType())) for m in MEASURES])


def _stripe(luma: np.ndarray) -> float:
    """Of lines along the first axis, the share of sampled ones that are much like the next."""
    lines, length = luma.shape
    if lines < 2:
        return 0.0
    step, gap = max(lines // max(min(lines - 1, MAX_LINES), 1), 1), max(length // LINE_SAMPLES, 1)
    at = np.arange(0, lines - 1, step)
    return float((np.abs(luma[at][:, ::gap] - luma[at + 1][:, ::gap]).sum(1) < STRIPE * len(range(0, length, gap))).mean())


def measure(px: np.ndarray) -> dict:
    """The measures of features() of one decoded image, without a row for each pixel."""
    full = raster.rgba(px)
    h, w, _ = full.shape
    rgb = full[..., :3].astype(np.int64)
    flat = rgb.reshape(-1, 3)
    key = (flat[:: max(len(flat) // MAX_PIXELS, 1)] * np.array([65536, 256, 1])).sum(1)
    _, times = np.unique(key, return_counts=True)
    luma = (19595 * rgb[..., 0] + 38470 * rgb[..., 1] + 7471 * rgb[..., 2] + 32768) >> 16
    rows = luma[:: max(h // EDGE_ROWS, 1)]
    edges = np.abs(np.diff(rows, axis=1))
    bh, bw = max(h // 4, 1), max(w // 4, 1)
    means = [luma[y * bh : (y + 1) * bh, x * bw : (x + 1) * bw].mean() for y in range(4) for x in range(4) if y * bh < h and x * bw < w]
    entropy = np.log2(times.sum()) - (times * np.log2(times)).sum() / times.sum()
    return {
        "w": w, "h": h, "mean_brightness": round(float(flat.mean(0).mean()), 6), "brightness_std": round(float(flat.std(0).mean()), 6), "palette_size": len(times), "unique_color_ratio": round(len(times) / int(times.sum()), 6),
        "color_entropy": round(abs(float(entropy)), 6), "edge_density": round(float((edges > EDGE).mean()), 6) if edges.size else 0.0, "spatial_uniformity": round(1 - min(1.0, float(np.var(means)) / 10_000), 6),
        "horizontal_stripe_score": round(_stripe(luma), 6), "vertical_stripe_score": round(_stripe(luma.T), 6), "has_transparency": bool((full[..., 3] < 255).any()), "is_grayscale": bool((rgb[..., 0] == rgb[..., 1]).all() and (rgb[..., 1] == rgb[..., 2]).all()),
    }


@F.arrow_udf(FEATURES)
def file_features(content: pa.Array) -> pa.Array:
    """The measures of PNG and BMP files; null for anything else."""
    rows = []
    for v in content:
        try:
            rows.append(measure(raster.read(v.as_py())[1]) if v.is_valid else None)
        except raster.Unreadable:
            rows.append(None)
    arrow = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}
    return pa.array(rows, pa.struct([(f.name, arrow[f.dataType]) for f in FEATURES.fields]))


#: (content type, SQL score), in the order that decides ties
CONTENT = (
    ("photograph", "CASE WHEN unique_color_ratio > 0.3 AND color_entropy > 15 THEN 3 ELSE 0 END + CASE WHEN brightness_std > 40 THEN 1 ELSE 0 END"),
    ("screenshot", "CASE WHEN stripe > 0.4 THEN 2 * stripe ELSE 0 END + CASE WHEN unique_color_ratio < 0.05 AND edge_density > 0.1 THEN 1.5 ELSE 0 END + CASE WHEN NOT has_transparency AND color_entropy < 12 THEN 0.5 ELSE 0 END"),
    ("diagram", "CASE WHEN palette_size < 512 AND edge_density > 0.15 THEN 1.5 ELSE 0 END"),
    ("chart", "CASE WHEN unique_color_ratio < 0.02 AND edge_density > 0.2 THEN 1.5 ELSE 0 END"),
    ("logo", "CASE WHEN palette_size < 256 AND has_transparency AND w <= 512 AND h <= 512 THEN 2.5 WHEN palette_size < 64 THEN 1.0 ELSE 0 END"),
    ("texture", "CASE WHEN spatial_uniformity > 0.7 AND color_entropy > 10 THEN 2 ELSE 0 END"),
)


def classified(rows: DataFrame, image: str) -> DataFrame:
    """Adds content_type, content_confidence, domain, domain_confidence, generation and generation_confidence of the struct column ``image`` of measures; null where it is."""
    f = rows.withColumn("_f", F.when(F.col(image).isNotNull(), F.struct(f"{image}.*", F.greatest(f"{image}.horizontal_stripe_score", f"{image}.vertical_stripe_score").alias("stripe"))))
    names = sorted((*MEASURES, "stripe"), key=len, reverse=True)

    def of(sql: str) -> Column:
        """The expression over the measures."""
        return F.expr(re.sub(r"\b(" + "|".join(names) + r")\b(?!')", r"_f.\1", sql))

    scored = F.array(*[F.struct(of(s).cast("double").alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, s) in enumerate(CONTENT)])
    f = f.withColumn("_all", scored).withColumn("_best", F.array_max("_all")).withColumn("_sum", F.aggregate("_all", F.lit(0.0), lambda a, x: a + x.s))
    gradient = of("stripe > 0.95 AND edge_density < 0.05")
    kind = F.when(gradient, "gradient").when(F.col("_sum") <= 0, "unknown").otherwise(F.col("_best.name"))
    sure = F.when(gradient, 1.0).when(F.col("_sum") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("_best.s") / F.col("_sum")))
    there = F.col("_f").isNotNull()
    f = f.withColumn("content_type", F.when(there, kind)).withColumn("content_confidence", F.when(there, F.round(sure, 6)))
    domain = of("CASE WHEN content_type = 'screenshot' THEN named_struct('d', 'ui', 'c', least(1.0D, 1.5D * stripe)) WHEN is_grayscale AND unique_color_ratio > 0.1 THEN named_struct('d', 'medical', 'c', 0.45D) WHEN w > 2000 AND h > 2000 AND color_entropy > 16 THEN named_struct('d', 'satellite', 'c', 0.35D) ELSE named_struct('d', 'general', 'c', 0.9D) END")
    made = of("CASE WHEN content_type = 'gradient' THEN named_struct('g', 'gradient', 'c', 0.9D) WHEN content_type = 'screenshot' THEN named_struct('g', 'screenshot', 'c', 0.88D) WHEN content_type = 'logo' AND has_transparency THEN named_struct('g', 'vector_render', 'c', 0.75D) WHEN unique_color_ratio > 0.4 AND color_entropy > 16 THEN named_struct('g', 'natural', 'c', 0.85D) WHEN unique_color_ratio < 0.001 AND spatial_uniformity > 0.85 THEN named_struct('g', 'synthetic', 'c', 0.7D) ELSE named_struct('g', 'natural', 'c', 0.55D) END")
    f = f.withColumn("_d", F.when(there, domain)).withColumn("_g", F.when(there, made))
    return f.withColumns({"domain": F.col("_d.d"), "domain_confidence": F.round("_d.c", 6), "generation": F.col("_g.g"), "generation_confidence": F.col("_g.c")}).drop("_f", "_all", "_best", "_sum", "_d", "_g")


def classify(found: DataFrame) -> DataFrame:
    """(img_id, content_type, content_confidence, domain, domain_confidence, generation, generation_confidence) of feature rows with has_transparency and is_grayscale."""
    return classified(found.select("img_id", F.struct(*MEASURES).alias("image")), "image").drop("image")


def linear_gradients(px: DataFrame) -> DataFrame:
    """(img_id, direction, worst, is_gradient): the straight line between the end colours of the middle row or column, against every pixel."""
    s = _with_size(px)
    ends = s.groupBy("img_id").agg(
        *[F.max(F.when((F.col("y") == F.expr("h div 2")) & (F.col("x") == 0), F.col(c))).alias(f"h0{c}") for c in "rgb"],
        *[F.max(F.when((F.col("y") == F.expr("h div 2")) & (F.col("x") == F.col("w") - 1), F.col(c))).alias(f"h1{c}") for c in "rgb"],
        *[F.max(F.when((F.col("x") == F.expr("w div 2")) & (F.col("y") == 0), F.col(c))).alias(f"v0{c}") for c in "rgb"],
        *[F.max(F.when((F.col("x") == F.expr("w div 2")) & (F.col("y") == F.col("h") - 1), F.col(c))).alias(f"v1{c}") for c in "rgb"],
    )
    both = s.join(ends, "img_id")

    def off(d: str, t: str) -> Column:
        return F.greatest(*[F.abs(F.col(c) - F.bround(F.col(f"{d}0{c}") + (F.col(f"{d}1{c}") - F.col(f"{d}0{c}")) * F.expr(t))) for c in "rgb"])

    worst = both.groupBy("img_id").agg(F.max(off("h", "x / greatest(w - 1, 1)")).alias("h"), F.max(off("v", "y / greatest(h - 1, 1)")).alias("v"))
    return worst.select("img_id", F.when(F.col("h") <= TOLERANCE, "horizontal").when(F.col("v") <= TOLERANCE, "vertical").alias("direction"), F.least("h", "v").cast("long").alias("worst"), (F.least("h", "v") <= TOLERANCE).alias("is_gradient"))


def render_gradients(params: DataFrame) -> DataFrame:
    """The pixel table of gradients (img_id, w, h, direction, start, stop); start and stop are arrays of red, green, blue."""
    at = params.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    t = F.when(F.col("direction") == "horizontal", F.expr("x / greatest(w - 1, 1)")).otherwise(F.expr("y / greatest(h - 1, 1)"))
    return at.select("img_id", "x", "y", *[F.bround(F.col("start")[i] + (F.col("stop")[i] - F.col("start")[i]) * t).cast("int").alias(c) for i, c in enumerate("rgb")])


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """(img_id, mse, psnr) of two pixel tables; null for equal images, whose ratio is infinite."""
    two = a.join(b.select("img_id", "x", "y", *[F.col(c).alias(f"_{c}") for c in "rgb"]), ["img_id", "x", "y"])
    mse = two.groupBy("img_id").agg((F.avg(sum(F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2)) for c in "rgb")) / 3).alias("mse"))
    return mse.select("img_id", F.round("mse", 6).alias("mse"), F.when(F.col("mse") > 0, F.round(20 * F.log10(255 / F.sqrt("mse")), 6)).alias("psnr"))
