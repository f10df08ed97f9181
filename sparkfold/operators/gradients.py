"""The procedural codec of linear gradients: two colours and a direction instead of pixels."""

from __future__ import annotations

import json

import numpy as np

from . import raster
from .verify import TOLERANCE


class Unsuitable(ValueError):
    """Not a linear gradient."""


def ramp(start: list[int], stop: list[int], n: int) -> np.ndarray:
    """n colours from start to stop; halves go to the even number."""
    a, b = np.array(start, float), np.array(stop, float)
    return np.rint(a + (b - a) * (np.arange(n) / max(n - 1, 1))[:, None]).astype(np.uint8)


def render(p: dict) -> np.ndarray:
    """The pixels of parameters width, height, angle (0 or 90), start, stop."""
    w, h = p["width"], p["height"]
    line = ramp(p["start"], p["stop"], w if p["angle"] == 0 else h)
    return np.tile(line[None], (h, 1, 1)) if p["angle"] == 0 else np.tile(line[:, None], (1, w, 1))


def detect(px: np.ndarray) -> dict | None:
    """The parameters whose pixels are nowhere further off than TOLERANCE; left to right is tried before top to bottom."""
    h, w, _ = px.shape
    for angle, line in ((0, px[h // 2]), (90, px[:, w // 2])):
        if len(line) < 2:
            continue
        p = {"angle": angle, "width": w, "height": h, "start": line[0].tolist(), "stop": line[-1].tolist()}
        if int(np.abs(render(p).astype(np.int16) - px).max()) <= TOLERANCE:
            return p
    return None


def compress(data: bytes) -> bytes:
    try:
        kind, px = raster.read(data)
    except raster.Unreadable as e:
        raise Unsuitable(str(e)) from e
    p = detect(px)
    if p is None:
        raise Unsuitable("not a linear gradient")
    return json.dumps(p | {"kind": kind}, separators=(",", ":")).encode()


def decompress(packed: bytes) -> bytes:
    p = json.loads(packed)
    return raster.write(p["kind"], render(p))
