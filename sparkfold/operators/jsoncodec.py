"""A codec for JSON arrays of objects with the same keys: columns instead of rows, then zstd.

Integers become differences, strings that repeat become indexes into a list in the order
of first appearance, everything else stays. Text that this form can't give back byte for
byte (other spacing, mixed keys, other nesting) is refused, so that another codec takes it.
"""

from __future__ import annotations

import json

import zstandard

MIN_BYTES, MIN_ROWS = 2048, 10
STYLES = ((None, (", ", ": ")), (None, (",", ":")), (2, (",", ": ")), (4, (",", ": ")))


class Unsuitable(ValueError):
    """Not a uniform JSON table, or not one that can be written back as it was."""


def _int(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def encode_column(values: list) -> dict:
    if all(map(_int, values)):
        return {"e": "delta", "v": [b - a for a, b in zip([0, *values[:-1]], values, strict=True)]}
    if all(isinstance(v, str) or v is None for v in values):
        index: dict[str | None, int] = {}
        codes = [index.setdefault(v, len(index)) for v in values]
        if len(index) * 2 <= len(values):
            return {"e": "dict", "v": codes, "d": list(index)}
    return {"e": "raw", "v": values}


def decode_column(column: dict) -> list:
    if column["e"] == "dict":
        return [column["d"][i] for i in column["v"]]
    if column["e"] == "delta":
        out, now = [], 0
        for d in column["v"]:
            now += d
            out.append(now)
        return out
    return column["v"]


def _dump(rows: list[dict], style: int, ascii_only: bool) -> bytes:
    indent, separators = STYLES[style]
    return json.dumps(rows, indent=indent, separators=separators, ensure_ascii=ascii_only).encode()


def compress(data: bytes, level: int = 19) -> bytes:
    if len(data) < MIN_BYTES:
        raise Unsuitable("too short")
    try:
        rows = json.loads(data)
    except ValueError as e:
        raise Unsuitable("not JSON") from e
    if not isinstance(rows, list) or len(rows) < MIN_ROWS or not all(isinstance(r, dict) for r in rows):
        raise Unsuitable("not a table")
    keys = list(rows[0])
    if not keys or any(list(r) != keys for r in rows):
        raise Unsuitable("rows with other keys")
    found = next(((s, a) for s in range(len(STYLES)) for a in (True, False) if _dump(rows, s, a) == data), None)
    if found is None:
        raise Unsuitable("written in another style")
    bundle = {"keys": keys, "style": found[0], "ascii": found[1], "columns": [encode_column([r[k] for r in rows]) for k in keys]}
    return zstandard.ZstdCompressor(level=level).compress(json.dumps(bundle, separators=(",", ":")).encode())


def decompress(packed: bytes) -> bytes:
    b = json.loads(zstandard.ZstdDecompressor().decompress(packed))
    columns = [decode_column(c) for c in b["columns"]]
    return _dump([dict(zip(b["keys"], r, strict=True)) for r in zip(*columns, strict=True)], b["style"], b["ascii"])
