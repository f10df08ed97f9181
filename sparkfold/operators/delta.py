"""Delta encoding of similar items against a reference: a raw-content zstd dictionary, or a byte-wise XOR."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions import content as C

LEVEL = 19
ENCODED = T.StructType([T.StructField("delta", T.BinaryType()), T.StructField("method", T.StringType()), T.StructField("ratio", T.DoubleType()), T.StructField("reference_hash", T.StringType()), T.StructField("target_hash", T.StringType())])
DECODED = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def xor_bytes(a: bytes, b: bytes) -> bytes:
    """a ^ b, the shorter one padded with zeros."""
    n = max(len(a), len(b))
    x, y = (np.frombuffer(v.ljust(n, b"\0"), np.uint8) for v in (a, b))
    return (x ^ y).tobytes()


@lru_cache(maxsize=1)
def _dictionary(reference: bytes, level: int) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Of the last reference; rows of one reference follow each other after the join with it."""
    d = zstandard.ZstdCompressionDict(reference, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def encode_one(reference: bytes, target: bytes, level: int = LEVEL, method: str = "zstd_dict") -> tuple[bytes, str]:
    """(delta, method): by a dictionary, or by XOR if that is asked for or the dictionary can't be used."""
    if method == "zstd_dict":
        try:
            return _dictionary(reference, level)[0].compress(target), method
        except (zstandard.ZstdError, ValueError, MemoryError):
            pass
    return len(target).to_bytes(4, "big") + zstandard.ZstdCompressor(level=level).compress(xor_bytes(reference, target)), "xor"


def decode_one(reference: bytes, delta: bytes, method: str, size: int) -> bytes:
    if method == "zstd_dict":
        return _dictionary(reference, LEVEL)[1].decompress(delta, max_output_size=max(size, 1))
    return xor_bytes(reference, zstandard.ZstdDecompressor().decompress(delta[4:], max_output_size=1 << 31))[: int.from_bytes(delta[:4], "big")]


@F.arrow_udf(T.BinaryType())
def xor(a: pa.Array, b: pa.Array) -> pa.Array:
    """xor_bytes of two columns."""
    return pa.array([None if x is None or y is None else xor_bytes(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.binary())


def encoder(level: int = LEVEL, method: str = "zstd_dict"):
    """(reference, target) to the encoded struct."""

    @F.arrow_udf(ENCODED)
    def encode(reference: pa.Array, target: pa.Array) -> pa.Array:
        rows = []
        for r, t in zip(reference.to_pylist(), target.to_pylist(), strict=True):
            if r is None or t is None:
                rows.append(None)
                continue
            delta, used = encode_one(r, t, level, method)
            rows.append({"delta": delta, "method": used, "ratio": round(len(t) / max(len(delta), 1), 2), "reference_hash": hashlib.sha256(r).hexdigest(), "target_hash": hashlib.sha256(t).hexdigest()})
        return pa.array(rows, pa.struct([("delta", pa.binary()), ("method", pa.string()), ("ratio", pa.float64()), ("reference_hash", pa.string()), ("target_hash", pa.string())]))

    return encode


@F.arrow_udf(DECODED)
def decode(reference: pa.Array, delta: pa.Array, method: pa.Array, reference_hash: pa.Array, target_hash: pa.Array, size: pa.Array) -> pa.Array:
    """The target, or null and what is wrong: a wrong reference, an unreadable delta, a wrong result."""
    rows = []
    for r, d, m, rh, th, n in zip(*(x.to_pylist() for x in (reference, delta, method, reference_hash, target_hash, size)), strict=True):
        if r is None or d is None:
            rows.append({"content": None, "error": "nothing to decode"})
        elif hashlib.sha256(r).hexdigest() != rh:
            rows.append({"content": None, "error": "hash mismatch of the reference"})
        else:
            try:
                t = decode_one(r, d, m, n)
                ok = hashlib.sha256(t).hexdigest() == th
                rows.append({"content": t if ok else None, "error": None if ok else "hash mismatch of the target"})
            except zstandard.ZstdError as e:
                rows.append({"content": None, "error": str(e)})
    return pa.array(rows, pa.struct([("content", pa.binary()), ("error", pa.string())]))


def references(items: DataFrame, group: str, id_col: str = "id", content: str = "content") -> DataFrame:
    """(group, reference_id, n_bytes): the longest item of each group, of equally long ones the smallest id. Content isn't shuffled."""
    size = C.size_of(F.col(content))
    light = items.select(group, F.col(id_col).alias("_id"), size.alias("_n"))
    best = light.groupBy(group).agg(F.max_by(F.struct("_id", "_n"), F.struct("_n", -F.col("_id"))).alias("r"))
    return best.select(group, F.col("r._id").alias("reference_id"), F.col("r._n").alias("n_bytes"))


def with_reference(items: DataFrame, refs: DataFrame, group: str, id_col: str = "id", content: str = "content") -> DataFrame:
    """Every other item beside its reference's content: (group, id, content, reference_id, reference)."""
    chosen = items.select(F.col(id_col).alias("reference_id"), F.col(content).alias("reference"))
    return items.select(group, F.col(id_col).alias("id"), F.col(content).alias("content")).join(refs.select(group, "reference_id"), group).where("id <> reference_id").join(chosen, "reference_id")


def differing_bytes(mixed: Column) -> Column:
    """How many bytes of an XOR aren't zero."""
    return C.size_of(mixed) - F.regexp_count(F.decode(mixed, "ISO-8859-1"), F.lit("\\x00")).cast("long")


def savings_percent(original: Column, delta: Column) -> Column:
    return F.round((1 - F.try_divide(delta, original)) * 100, 1)
