"""Codecs behind one registry: a compressor and a decompressor of bytes, run over Arrow batches."""

from __future__ import annotations

import hashlib
import lzma
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions import content as C
from sparkfold.functions.lineage import spread

from . import bundles, gradients, jsoncodec
from .verify import sameness

try:
    import brotli
except ImportError:  # an optional library
    brotli = None


@dataclass(frozen=True)
class Codec:
    """``estimate`` is an SQL expression over entropy, size and format_type; ``applies`` one over a report row. ``streaming``: large content may be given to it in windows."""

    name: str
    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes], bytes]
    estimate: str
    applies: str = "true"
    streaming: bool = False


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    """One for each level and worker; making one costs more than compressing a short text."""
    return zstandard.ZstdCompressor(level=level)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _zstd(level: int = 19) -> Codec:
    return Codec("traditional_zstd", lambda b: _compressor(level).compress(b), lambda b: _decompressor().decompress(b), "CASE WHEN entropy >= 8 THEN 1.0D WHEN entropy <= 0 THEN 100.0D ELSE round(8.0D / greatest(entropy, 0.1D), 2) END", streaming=True)


#: Dictionaries of the presets.
_LZMA_DICTIONARY = tuple(1 << n for n in (18, 20, 21, 22, 22, 23, 23, 24, 25, 26))


def _lzma_filters(size: int, preset: int) -> list[dict]:
    """The preset, with a dictionary no larger than the content: the same matches are found, but a short text doesn't clear tables for megabytes."""
    return [{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": min(_LZMA_DICTIONARY[preset], 1 << max(12, (size - 1).bit_length()))}]


def _lzma(preset: int = 6) -> Codec:
    if not 0 <= preset <= 9:
        raise ValueError("lzma presets are 0 to 9")
    return Codec("traditional_lzma", lambda b: lzma.compress(b, filters=_lzma_filters(len(b), preset)), lzma.decompress, "CASE WHEN entropy < 3 THEN 12.0D WHEN entropy < 5 THEN 6.0D WHEN entropy < 7 THEN 3.0D ELSE 2.5D END", streaming=True)


def _brotli(quality: int = 9) -> Codec:
    if not 0 <= quality <= 11:
        raise ValueError("brotli qualities are 0 to 11")

    def need():
        if brotli is None:
            raise RuntimeError("the brotli library is not installed")
        return brotli

    return Codec("traditional_brotli", lambda b: need().compress(b, quality=quality), lambda b: need().decompress(b), "CASE WHEN entropy < 3 THEN 10.0D WHEN entropy < 5 THEN 5.0D WHEN entropy < 7 THEN 2.5D ELSE 2.0D END", "category IN ('text', 'data')")


CODECS: dict[str, Codec] = {}


def register_codec(codec: Codec) -> None:
    """The last registration of a name counts."""
    CODECS[codec.name] = codec


_json = Codec("semantic_json", jsoncodec.compress, jsoncodec.decompress, "CASE WHEN size > 50000 THEN 80.0D WHEN size > 10000 THEN 40.0D ELSE 15.0D END", "category = 'data'")
_gradient = Codec("procedural_gradient", gradients.compress, gradients.decompress, "least(size / 200.0D, 50000.0D)", "category = 'image' AND content_type = 'gradient' AND content_confidence > 0.7")
_pdf = Codec("semantic_pdf", bundles.pdf_compress, bundles.pdf_decompress, "CASE WHEN entropy < 5 THEN 8.0D ELSE 5.0D END", "format_type = 'PDF'")
for _codec in (_zstd(), _brotli(), _lzma(), _json, _gradient, _pdf):
    register_codec(_codec)


def run_length(data: bytes) -> bytes:
    """(length, byte) of each run, runs of at most 255."""
    b = np.frombuffer(data, np.uint8)
    at = np.append(np.flatnonzero(np.diff(b, prepend=b[:1] + np.uint8(1))), len(b))
    size = np.diff(at)
    times = -(-size // 255)
    out = np.empty((times.sum(), 2), np.uint8)
    out[:, 0], out[:, 1] = 255, np.repeat(b[at[:-1]], times)
    out[np.cumsum(times) - 1, 0] = size - (times - 1) * 255
    return out.tobytes()


def un_run_length(packed: bytes) -> bytes:
    pairs = np.frombuffer(packed, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()


def delta_run_length(data: bytes) -> bytes:
    """The run lengths of each byte's difference to the one before."""
    return run_length(np.diff(np.frombuffer(data, np.uint8), prepend=np.uint8(0)).tobytes())


def un_delta_run_length(packed: bytes) -> bytes:
    return np.cumsum(np.frombuffer(un_run_length(packed), np.uint8), dtype=np.uint8).tobytes()


#: Codecs that aren't tried by default: office bundles restore members, not bytes, and the other two, whose sizes don't depend on any library, are for measurements.
OPTIONAL: dict[str, Codec] = {
    c.name: c
    for c in (
        Codec("semantic_office", bundles.office_compress, bundles.office_decompress, "CASE format_type WHEN 'DOCX' THEN 6.0D WHEN 'XLSX' THEN 8.0D ELSE 4.0D END", "format_type IN ('DOCX', 'XLSX', 'PPTX')"),
        Codec("run_length", run_length, un_run_length, "1.0D", streaming=True),
        Codec("delta_run_length", delta_run_length, un_delta_run_length, "1.0D"),
    )
}


def codec(name: str) -> Codec:
    found = CODECS.get(name) or OPTIONAL.get(name)
    if found is None:
        raise KeyError(f"no codec named {name}")
    return found


def with_levels(zstd: int = 19, lzma_preset: int = 6, brotli_quality: int = 9) -> None:
    """Registers the three again with other levels."""
    for c in (_zstd(zstd), _lzma(lzma_preset), _brotli(brotli_quality)):
        register_codec(c)


ATTEMPT = T.StructType([T.StructField("strategy", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("original_size", T.LongType()), T.StructField("compressed_size", T.LongType()), T.StructField("lossless", T.BooleanType()), T.StructField("verified", T.StringType()), T.StructField("restored_hash", T.StringType()), T.StructField("error", T.StringType()), T.StructField("compression_ms", T.DoubleType()), T.StructField("decompression_ms", T.DoubleType()), T.StructField("packed", T.BinaryType())])
_ARROW = pa.struct([("strategy", pa.string()), ("ord", pa.int32()), ("original_size", pa.int64()), ("compressed_size", pa.int64()), ("lossless", pa.bool_()), ("verified", pa.string()), ("restored_hash", pa.string()), ("error", pa.string()), ("compression_ms", pa.float64()), ("decompression_ms", pa.float64()), ("packed", pa.binary())])


def attempt(c: Codec, data: bytes, order: int) -> dict:
    """One verified attempt; a failure is a row with its error. ``verified`` says whether bytes or pixels are the same, ``restored_hash`` is that of what comes back."""
    row = {"strategy": c.name, "ord": order, "original_size": len(data), "compressed_size": None, "lossless": False, "verified": None, "restored_hash": None, "error": None, "compression_ms": None, "decompression_ms": None, "packed": None}
    try:
        began = time.perf_counter()
        packed = c.compress(data)
        middle = time.perf_counter()
        back = c.decompress(packed)
        row |= {"compression_ms": (middle - began) * 1e3, "decompression_ms": (time.perf_counter() - middle) * 1e3}
        same = sameness(data, back)
        row |= {"compressed_size": len(packed), "lossless": same is not None, "verified": same, "restored_hash": hashlib.sha256(back).hexdigest(), "packed": packed}
    except Exception as e:  # any failure of a codec is a result of the attempt
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def attempts_udf(names: Sequence[str], excellent: float = 50.0):
    """Binary content to its attempts, in order; no further codec is tried after a verified ratio of ``excellent``."""
    chosen = [codec(n) for n in names]

    @F.arrow_udf(T.ArrayType(ATTEMPT))
    def run(content: pa.Array) -> pa.Array:
        out = []
        for v in content:
            if not v.is_valid:
                out.append(None)
                continue
            data, rows = v.as_py(), []
            for i, c in enumerate(chosen):
                rows.append(attempt(c, data, i))
                size = rows[-1]["compressed_size"]
                if rows[-1]["lossless"] and size and len(data) / size >= excellent:
                    break
            out.append(rows)
        return pa.array(out, pa.list_(_ARROW))

    return run


def attempts(items: DataFrame, names: Sequence[str], id_col: str = "id", content: str = "content", excellent: float = 50.0, keep_packed: bool = False) -> DataFrame:
    """(file_id, strategy, ord, sizes, lossless, error, times[, packed]) of every attempt."""
    rows = spread(items).select(F.col(id_col).alias("file_id"), F.explode(attempts_udf(names, excellent)(F.col(content))).alias("a")).select("file_id", "a.*")
    return rows if keep_packed else rows.drop("packed")


def compressor(name: str):
    c = codec(name)

    @F.arrow_udf(T.BinaryType())
    def run(content: pa.Array) -> pa.Array:
        return pa.array([c.compress(v.as_py()) if v.is_valid else None for v in content], pa.binary())

    return run


def decompressor(name: str):
    c = codec(name)

    @F.arrow_udf(T.BinaryType())
    def run(packed: pa.Array) -> pa.Array:
        return pa.array([c.decompress(v.as_py()) if v.is_valid else None for v in packed], pa.binary())

    return run


@F.arrow_udf(T.BinaryType())
def restored(packed: pa.Array, strategy: pa.Array) -> pa.Array:
    """Each payload by the codec of its strategy, one at a time."""
    return pa.array([codec(s).decompress(v.as_py()) if v.is_valid and s else None for v, s in zip(packed, strategy.to_pylist(), strict=True)], pa.binary())


def _rounded(x: float) -> float:
    """x at 6 digits, halves upwards as Spark rounds them."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def best_of(items: DataFrame, names: Sequence[str], id_col: str = "id", content: str = "content") -> DataFrame:
    """(file_id, original_size, strategy, ratio, packed) of the verified attempt with the best ratio at 6 digits, the first of equals; null where none is verified. It is chosen in the row: each codec runs once, and only the payload that is kept leaves Python."""
    chosen = [codec(n) for n in names]
    kind = T.StructType([T.StructField("strategy", T.StringType()), T.StructField("ratio", T.DoubleType()), T.StructField("packed", T.BinaryType())])

    @F.arrow_udf(kind)
    def run(content: pa.Array) -> pa.Array:
        out = []
        for v in content:
            best = None
            for i, c in enumerate(chosen) if v.is_valid else ():
                a = attempt(c, v.as_py(), i)
                if a["error"] is None and a["lossless"]:
                    ratio = _rounded(a["original_size"] / a["compressed_size"]) if a["compressed_size"] else 0.0
                    if best is None or ratio > best["ratio"]:
                        best = {"strategy": c.name, "ratio": ratio, "packed": a["packed"]}
            out.append(best)
        return pa.array(out, pa.struct([("strategy", pa.string()), ("ratio", pa.float64()), ("packed", pa.binary())]))

    rows = spread(items.select(F.col(id_col).alias("file_id"), F.col(content).alias("content")))
    return rows.select("file_id", C.size_of(F.col("content")).alias("original_size"), run("content").alias("b")).select("file_id", "original_size", "b.strategy", "b.ratio", "b.packed")


def estimates(reports: DataFrame) -> DataFrame:
    """(file_id, strategy, est_ratio) of every codec that applies to a report."""
    each = F.array_compact(F.array(*[F.when(F.expr(c.applies), F.struct(F.lit(c.name).alias("strategy"), F.expr(c.estimate).alias("est_ratio"))) for c in (*CODECS.values(), OPTIONAL["semantic_office"])]))
    return reports.select("file_id", F.explode(each).alias("e")).select("file_id", "e.*")


def roundtrip(items: DataFrame, name: str, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, original_size, restored_hash, lossless) after compressing and decompressing, in one Python pass."""
    c = codec(name)
    kind = T.StructType([T.StructField("hash", T.StringType()), T.StructField("same", T.BooleanType())])

    @F.arrow_udf(kind)
    def there_and_back(values: pa.Array) -> pa.Array:
        rows = []
        for v in values:
            data = v.as_py()
            back = c.decompress(c.compress(data)) if data is not None else None
            rows.append({"hash": None if back is None else hashlib.sha256(back).hexdigest(), "same": back is not None and back == data})
        return pa.array(rows, pa.struct([("hash", pa.string()), ("same", pa.bool_())]))

    done = spread(items.select(id_col, content)).select(id_col, C.size_of(F.col(content)).alias("original_size"), there_and_back(F.col(content)).alias("r"))
    return done.select(id_col, "original_size", F.col("r.hash").alias("restored_hash"), F.col("r.same").alias("lossless"))
