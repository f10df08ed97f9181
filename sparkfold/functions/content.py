"""Columns over binary content: samples, blocks, histograms, entropy and the labels derived from it.

Slicing, hashing and labelling are built-in expressions. Byte histograms aren't: one row
for each byte would multiply the input by a hundred, so they are numpy over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = 4 << 20
SAMPLE = 1 << 20
#: Bytes counted at once.
PIECE = 1 << 20


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def size_of(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def slice_of(content: Column, offset: Column | int, length: Column | int) -> Column:
    """Bytes from a 0-based offset."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    n = F.lit(length) if isinstance(length, int) else length
    return F.substring(content, (at + 1).cast("int"), n.cast("int"))


def prefix_sample(content: Column, limit: int = PREFIX) -> Column:
    return slice_of(content, 0, limit)


def three_point_sample(content: Column, budget: int = SAMPLE) -> Column:
    """The content if it fits the budget, else a third of the budget from its start, middle and end."""
    third, n = budget // 3, size_of(content)
    parts = F.concat(slice_of(content, 0, third), slice_of(content, F.floor(n / 2), third), slice_of(content, n - third, third))
    return F.when(n <= budget, content).otherwise(parts)


def block_count(content: Column, block: int) -> Column:
    return F.ceil(size_of(content) / block).cast("int")


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits a byte of each row of counts; 0 for an empty one."""
    total = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(total, 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1) + 0.0


def _bytes(values: pa.Array, i: int) -> np.ndarray:
    """Row i of a binary array, without a copy."""
    return np.frombuffer(values[i].as_buffer(), np.uint8)


def _counts(b: np.ndarray) -> np.ndarray:
    """How often each byte occurs, counted in pieces."""
    return sum((np.bincount(b[lo : lo + PIECE], minlength=256) for lo in range(0, len(b), PIECE)), np.zeros(256, np.int64))


@F.arrow_udf(T.DoubleType())
def entropy(content: pa.Array) -> pa.Array:
    """Shannon entropy of the bytes, at 6 digits."""
    out = [None if not v.is_valid else float(_entropy(_counts(np.frombuffer(v.as_buffer(), np.uint8)))) for v in content]
    return pa.array([None if e is None else round(abs(e), 6) for e in out], pa.float64())


@F.arrow_udf(T.ArrayType(T.LongType()))
def histogram(content: pa.Array) -> pa.Array:
    """How often each of the 256 bytes occurs."""
    return pa.array([_counts(np.frombuffer(v.as_buffer(), np.uint8)) if v.is_valid else None for v in content], pa.list_(pa.int64()))


def block_entropies(block: int):
    """A function of binary content to the entropies of its blocks, at 6 digits."""
    step = max(1, PIECE // block) * block

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def of(content: pa.Array) -> pa.Array:
        out = []
        for v in content:
            if not v.is_valid:
                out.append(None)
                continue
            b = np.frombuffer(v.as_buffer(), np.uint8)
            found = [np.zeros(0)]
            for lo in range(0, len(b), step):
                part = b[lo : lo + step]
                n = -(-len(part) // block)
                key = (np.arange(len(part)) // block) * 256 + part
                found.append(np.round(np.abs(_entropy(np.bincount(key, minlength=n * 256).reshape(n, 256))), 6))
            out.append(np.concatenate(found))
        return pa.array(out, pa.list_(pa.float64()))

    return of


@F.arrow_udf(T.BinaryType())
def joined(parts: pa.Array) -> pa.Array:
    """An array of binaries end to end; null if one of them is."""
    out = []
    for v in parts:
        values = v.values if v.is_valid else None
        out.append(None if values is None or values.null_count else b"".join(x.as_py() for x in values))
    return pa.array(out, pa.binary())


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def line_count(text: Column) -> Column:
    """How many line breaks a text has."""
    return F.regexp_count(text, F.lit("\n")).cast("long")


def human_size(n: Column) -> Column:
    """1536 as 1.5 KB."""
    x = n.cast("double")
    return F.when(n < 1 << 10, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KB", x / (1 << 10))).when(n < 1 << 30, F.format_string("%.1f MB", x / (1 << 20))).otherwise(F.format_string("%.1f GB", x / (1 << 30)))


def ratio_estimate(e: Column) -> Column:
    """The compression ratio that an entropy promises."""
    return F.when(e >= 8, 1.0).when(e <= 0, 100.0).otherwise(F.round(8.0 / F.greatest(e, F.lit(0.1)), 2))


def compressibility_label(e: Column) -> Column:
    return F.when(e < 2, "Excellent").when(e < 4, "Good").when(e < 6, "Moderate").when(e < 7.5, "Limited").otherwise("Poor")


def entropy_bar(e: Column, width: int = 20) -> Column:
    n = F.bround(e / 8 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def is_random(e: Column) -> Column:
    return e > 7.9


def is_highly_compressible(e: Column) -> Column:
    return e < 4.0
