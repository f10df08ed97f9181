"""What counts as the same after a round trip: equal bytes, or for PNG files pixels within a tolerance."""

from __future__ import annotations

import numpy as np

from . import raster

TOLERANCE = 2


def sameness(original: bytes, restored: bytes) -> str | None:
    """"bytes", "pixels" (both PNG, equal in size and channels, no channel further off than TOLERANCE), or None."""
    if original == restored:
        return "bytes"
    if original[:8] != raster.PNG or restored[:8] != raster.PNG:
        return None
    try:
        a, b = raster.read(original)[1], raster.read(restored)[1]
    except raster.Unreadable:
        return None
    return "pixels" if a.shape == b.shape and int(np.abs(a.astype(np.int16) - b).max(initial=0)) <= TOLERANCE else None
