"""From files to verified compressed rows, and back: profile, rank, try in order, keep the best."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions import content as C
from sparkfold.functions.lineage import spread
from sparkfold.sources import archives

from . import codecs, formats, images, selection

EXCELLENT, MEMORY_MB = 50.0, 512
_KEPT = "name string, original_size long, path string, format string, content_sha256 string, strategy string, payload binary, tried int, errors array<string>, verified string, restored_sha256 string"
#: (condition, note) on an analysed row
NOTES = (
    ("is_random", "no redundancy left: compressed, encrypted or random"),
    ("entropy > 7.5 AND NOT is_random", "little redundancy left"),
    ("content_type = 'gradient'", "a gradient: two colours can stand for all pixels"),
    ("content_type = 'screenshot'", "a screenshot: flat areas and repeated glyphs"),
    ("format_type IN ('DOCX', 'XLSX', 'PPTX')", "an archive of parts, which can be compressed one by one"),
    ("format_type = 'PDF'", "streams inside are deflated already"),
    ("category = 'medical'", "medical images need a lossless codec"),
    ("size = 0", "empty"),
)


def analyse(files: DataFrame) -> DataFrame:
    """(path, content) with format, entropy, image class, hints, notes and the recommended strategy beside each file.

    Archives are looked into for what they hold, PNG and BMP files for their pixels; other
    images have no class.
    """
    looked = files.withColumns({"header": C.slice_of(F.col("content"), 0, 256), "members": archives.member_names(F.col("content"))})
    shaped = formats.detect(looked, members="members").drop("header", "members")
    e = F.col("entropy")
    rows = shaped.withColumns({"size": C.size_of(F.col("content")), "entropy": C.entropy(F.col("content"))})
    rows = rows.withColumns({"est_ratio": C.ratio_estimate(e), "label": C.compressibility_label(e), "is_random": C.is_random(e), "is_highly_compressible": C.is_highly_compressible(e)})
    rows = rows.withColumnsRenamed({"type": "format_type", "confidence": "format_confidence"})
    rows = images.classified(rows.withColumn("image", images.file_features(F.col("content"))), "image")
    hinted = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in selection.HINTS]))
    noted = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(note)) for c, note in NOTES]))
    return rows.withColumns({"hints": hinted, "notes": noted}).withColumn("recommended", F.coalesce(F.try_element_at("hints", F.lit(1)), F.lit(selection.FALLBACK)))


def summary(analysed: DataFrame) -> DataFrame:
    """(path, text): each file in a sentence."""
    image = F.when(F.col("content_type").isNotNull(), F.format_string("; %s image of %d x %d", "content_type", F.col("image.w"), F.col("image.h"))).otherwise("")
    text = F.concat(F.format_string("%s (%s), %s, entropy %.3f (%s), about %.2fx", "format_type", "mime_type", C.human_size(F.col("size")), "entropy", "label", "est_ratio"), image, F.lit("; try "), F.array_join("hints", ", "))
    return analysed.select("path", text.alias("text"))


def strategies(memory_mb: int = MEMORY_MB) -> Column:
    """The ranked names of registered strategies that fit the memory, for an analysed row; the fallback stays."""
    fits = [n for n in codecs.CODECS if selection.MEMORY_MB.get(n, selection.MEMORY_DEFAULT_MB) <= memory_mb or n == selection.FALLBACK]
    return F.transform(selection.ranking(fits), lambda x: x.strategy)


def _best(data: bytes, order: list[str]) -> dict:
    """The best verified attempt; the first at EXCELLENT ends the search, the first of equals wins."""
    best, errors, tried = None, [], 0
    for i, name in enumerate(order):
        tried += 1
        a = codecs.attempt(codecs.codec(name), data, i)
        if a["error"] or not a["lossless"]:
            errors.append(f"{name}: {a['error'] or 'not lossless'}")
            continue
        ratio = len(data) / max(a["compressed_size"], 1)
        if best is None or ratio > best[0]:
            best = (ratio, a)
        if ratio >= EXCELLENT:
            break
    a = best[1] if best else {}
    return {"strategy": a.get("strategy"), "payload": a.get("packed"), "tried": tried, "errors": errors, "verified": a.get("verified"), "restored_sha256": a.get("restored_hash")}


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, original_size, path, format, content, strategies) to rows of _KEPT, one file at a time."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]
    names = [x.split()[0] for x in _KEPT.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in ("name", "original_size", "path", "format")}
            data = batch.column("content")[i].as_py()
            row |= {"content_sha256": hashlib.sha256(data).hexdigest()} | _best(data, batch.column("strategies")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names=names)


def relative(path: Column, root: str | None) -> Column:
    """The path below the root; without one all of it but the scheme. Two files of one source never have the same."""
    plain = F.regexp_replace(path, "^[A-Za-z0-9]+:/*", "")
    if root is None:
        return F.regexp_replace(plain, "^/+", "")
    base = root.split(":", 1)[-1].strip("/")
    inside = F.when(plain == base, F.element_at(F.split(plain, "/"), -1)).when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2)))
    return F.coalesce(inside, plain)


def compress(files: DataFrame, root: str | None = None, memory_mb: int = MEMORY_MB) -> DataFrame:
    """(name, original_size, strategy, metadata, payload, tried, errors): rows that the container source writes, named by their paths below ``root``. A file that nothing takes has a null strategy."""
    ready = analyse(files).where("content IS NOT NULL").select(relative(F.col("path"), root).alias("name"), F.col("size").alias("original_size"), "path", F.col("format_type").alias("format"), "content", strategies(memory_mb).alias("strategies"))
    rows = spread(ready).mapInArrow(_tried, _KEPT)  # rows, not a function of columns, which the planner may copy or move
    keys = ("path", "format", "content_sha256", "verified", "restored_sha256")
    return rows.select("name", "original_size", "strategy", F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*keys)).alias("metadata"), "payload", "tried", "errors")


@F.arrow_udf(T.BinaryType())
def _restore(payload: pa.Array, strategy: pa.Array) -> pa.Array:
    return pa.array([codecs.codec(s).decompress(v.as_py()) if v.is_valid and s else None for v, s in zip(payload, strategy.to_pylist(), strict=True)], pa.binary())


def decompress(rows: DataFrame) -> DataFrame:
    """(name, content, verified) of container rows: whether the content is what it was checked to be when it was compressed."""
    back = rows.withColumn("content", _restore(F.col("payload"), F.col("strategy")))
    want = F.coalesce(F.try_element_at("metadata", F.lit("restored_sha256")), F.try_element_at("metadata", F.lit("content_sha256")))
    return back.select("name", "content", F.coalesce(F.sha2("content", 256) == want, F.lit(False)).alias("verified"))
