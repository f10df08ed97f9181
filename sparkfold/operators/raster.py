"""Raster files without an image library: PNG (8 bits, not interlaced) and BMP (24 and 32 bits) to arrays of pixels and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Unreadable(ValueError):
    """Not a raster file of a kind that is read here."""


def _unfilter(raw: np.ndarray, height: int, stride: int, bpp: int) -> np.ndarray:
    """The scan lines of a PNG with their filters taken back."""
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = np.zeros(stride, np.uint8)
            for x in range(0, stride, bpp):  # each pixel needs the one before
                up = above[x : x + bpp].astype(np.int16)
                left = now[x - bpp : x].astype(np.int16) if x else np.zeros(bpp, np.int16)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[x - bpp : x].astype(np.int16) if x else np.zeros(bpp, np.int16)
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                now[x : x + bpp] = line[x : x + bpp] + guess.astype(np.uint8)
        else:
            raise Unreadable("an unknown filter")
        out[y] = above = now
    return out


def _read_png(data: bytes) -> np.ndarray:
    at, parts, palette, alpha, head = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += n + 12
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise Unreadable("a PNG of another kind")
    w, h, bpp = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != h * (w * bpp + 1):
        raise Unreadable("a PNG of another size")
    px = _unfilter(raw, h, w * bpp, bpp).reshape(h, w, bpp)
    if head[3] == 3:
        if palette is None or px.max(initial=0) >= len(palette):
            raise Unreadable("a PNG without its palette")
        rgb = palette[px[..., 0]]
        if alpha is None:
            return rgb
        full = np.full(256, 255, np.uint8)
        full[: len(alpha)] = alpha
        return np.concatenate((rgb, full[px]), 2)
    return px


def _read_bmp(data: bytes) -> np.ndarray:
    offset, size, w, h, _, bits, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or bits not in (24, 32) or packing not in (0, 3) or w <= 0 or not h:
        raise Unreadable("a BMP of another kind")
    bpp, stride = bits // 8, -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, offset).reshape(abs(h), stride)[:, : w * bpp].reshape(abs(h), w, bpp)
    return (rows if h < 0 else rows[::-1])[..., [2, 1, 0, 3][:bpp]]


def read(data: bytes) -> tuple[str, np.ndarray]:
    """("PNG" or "BMP", height x width x channels of 1 (gray), 2 (gray, alpha), 3 (RGB) or 4 (RGBA) bytes)."""
    try:
        if data[:8] == PNG:
            return "PNG", _read_png(data)
        if data[:2] == b"BM":
            return "BMP", _read_bmp(data)
    except (struct.error, zlib.error, ValueError) as e:
        raise Unreadable(str(e)) from e
    raise Unreadable("no raster file")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write(kind: str, px: np.ndarray, level: int = 6) -> bytes:
    """The pixels as a file."""
    h, w, bpp = px.shape
    if kind == "BMP":
        if bpp not in (3, 4):
            raise Unreadable("BMP needs colours")
        rows = np.zeros((h, -(-w * bpp // 4) * 4), np.uint8)
        rows[:, : w * bpp] = px[::-1][..., [2, 1, 0, 3][:bpp]].reshape(h, -1)
        return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * bpp, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()
    lines = np.zeros((h, w * bpp + 1), np.uint8)
    lines[:, 1:] = px.reshape(h, -1)
    kinds = {1: 0, 2: 4, 3: 2, 4: 6}
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kinds[bpp], 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def rgba(px: np.ndarray) -> np.ndarray:
    """Any of the forms of read() as four channels."""
    h, w, n = px.shape
    colour = np.repeat(px[..., :1], 3, 2) if n < 3 else px[..., :3]
    return np.concatenate((colour, px[..., -1:] if n in (2, 4) else np.full((h, w, 1), 255, np.uint8)), 2)
