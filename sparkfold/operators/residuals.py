"""Residual coding around a lossy codec: what the codec loses is kept as 16-bit differences, so the whole is lossless.

No model weights come with this library; ``CODECS`` says what a codec of a domain has to
look like, and ``lossless`` wraps any pair of functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: domain: (side of the square input, latent channels, usual ratio)
CODECS = {"medical": (512, 256, 35.0), "ui_screenshot": (512, 512, 28.0), "satellite": (512, 256, 45.0), "architectural": (512, 128, 80.0)}
CONFIDENCE = 0.6


def residual(original: np.ndarray, rebuilt: np.ndarray) -> np.ndarray:
    return original.astype(np.int16) - rebuilt.astype(np.int16)


def restore(rebuilt: np.ndarray, difference: np.ndarray) -> np.ndarray:
    return np.clip(rebuilt.astype(np.int16) + difference, 0, 255).astype(np.uint8)


def applies(domain: str, confidence: float, codec: str) -> bool:
    """Whether a domain's codec may take an image."""
    return domain == codec and confidence > CONFIDENCE and codec in CODECS


def to_tensor(image: np.ndarray) -> np.ndarray:
    """Height x width x 3 bytes as 1 x 3 x height x width in [0, 1]."""
    return (image.astype(np.float32) / 255).transpose(2, 0, 1)[None]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w, _ = image.shape
    if (h, w) == (height, width):
        return image
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = image.astype(np.float64)
    top, bottom = (f[r][:, x0] * (1 - fx) + f[r][:, x1] * fx for r in (y0, y1))
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def mean_residual(original: Column, rebuilt: Column) -> Column:
    """The mean distance of two arrays of numbers of one length, at 6 digits; null for empty ones."""
    apart = F.zip_with(original, rebuilt, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return F.round(F.try_divide(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x), F.size(apart)), 6)


def codec(encode: Callable[[np.ndarray], bytes], decode: Callable[[bytes], np.ndarray], level: int = 19):
    """Two column functions around a lossy pair of flat byte arrays: binary to (latent, difference), and back."""
    there, back = lossless(encode, decode, level)
    kind = T.StructType([T.StructField("latent", T.BinaryType()), T.StructField("difference", T.BinaryType())])

    @F.arrow_udf(kind)
    def compress(values: pa.Array) -> pa.Array:
        rows = [dict(zip(("latent", "difference"), there(np.frombuffer(v.as_buffer(), np.uint8)), strict=True)) if v.is_valid else None for v in values]
        return pa.array(rows, pa.struct([("latent", pa.binary()), ("difference", pa.binary())]))

    @F.arrow_udf(T.BinaryType())
    def decompress(latent: pa.Array, difference: pa.Array) -> pa.Array:
        return pa.array([back(a, b).tobytes() if a is not None else None for a, b in zip(latent.to_pylist(), difference.to_pylist(), strict=True)], pa.binary())

    return compress, decompress


def from_tensor(tensor: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(tensor[0].transpose(1, 2, 0) * 255), 0, 255).astype(np.uint8)


def lossless(encode: Callable[[np.ndarray], bytes], decode: Callable[[bytes], np.ndarray], level: int = 19) -> tuple[Callable[[np.ndarray], tuple[bytes, bytes]], Callable[[bytes, bytes], np.ndarray]]:
    """(compress, decompress) around a lossy pair."""

    def compress(image: np.ndarray) -> tuple[bytes, bytes]:
        latent = encode(image)
        return latent, zstandard.ZstdCompressor(level=level).compress(residual(image, decode(latent)).tobytes())

    def decompress(latent: bytes, difference: bytes) -> np.ndarray:
        rebuilt = decode(latent)
        return restore(rebuilt, np.frombuffer(zstandard.ZstdDecompressor().decompress(difference), np.int16).reshape(rebuilt.shape))

    return compress, decompress
