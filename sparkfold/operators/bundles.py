"""Component bundles: the parts of an office archive or a PDF, each with the codec that suits it, equal parts once.

A bundle is MARK, the length of a zstd frame and that frame: a JSON header (what it is, and of
every part path, type, codec, size, pages and meta). The hashes of the parts and the stored
parts follow as they are: both are noise to another pass of zstd, which took a sixth of the
time of a small file. Bundles of the first form (all of that in one zstd frame) are read too.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Sequence
from functools import cache

import zstandard

from . import gradients

#: What a bundle begins with; a zstd frame never does.
MARK = b"SFB2"
MARKERS = (("DOCX", "word/document.xml"), ("XLSX", "xl/workbook.xml"), ("PPTX", "ppt/presentation.xml"))


class Unsuitable(ValueError):
    """Not a file that this form holds."""


@cache
def _zstd(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@cache
def _dctx() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _unzstd(data: bytes | memoryview) -> bytes:
    return _dctx().decompress(data)


def member(z: zipfile.ZipFile, data: bytes | memoryview, info: zipfile.ZipInfo) -> bytes:
    """What ``z.read(info)`` gives for the archive ``data``: in one step if nothing about the member is unusual, else by zipfile and with its errors."""
    at, name = info.header_offset, info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace")
    head = bytes(data[at : at + 30 + len(name)])
    if info.compress_type == zipfile.ZIP_DEFLATED and not info.flag_bits & 0x61 and head[:4] == b"PK\x03\x04" and head[30:] == name and int.from_bytes(head[26:28], "little") == len(name):
        start = at + len(head) + int.from_bytes(head[28:30], "little")
        end, most = start + info.compress_size, getattr(info, "_end_offset", None)
        d = zlib.decompressobj(-15)
        try:
            found = d.decompress(data[start:end], info.file_size + 1)
        except zlib.error:
            found = None
        if found is not None and d.eof and len(found) == info.file_size and zlib.crc32(found) == info.CRC and (most is None or end <= most):
            return found
    return z.read(info)


def zipped(members: Sequence[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of these (path, data), deflated.

    It has what zipfile writes, but windows and tables no larger than a member needs:
    most are small, and setting up full ones costs more than deflating them.
    """
    names = [path.encode() for path, _ in members]
    if len(names) > 0xFFFE or sum(len(d) + len(n) for n, (_, d) in zip(names, members, strict=True)) > 1 << 31 or any(b"\0" in n or len(n) > 0xFFFF for n in names):
        held = io.BytesIO()  # 64-bit fields and odd names
        with zipfile.ZipFile(held, "w", compression=zipfile.ZIP_DEFLATED) as z:
            for path, data in members:
                z.writestr(zipfile.ZipInfo(path), data, compress_type=zipfile.ZIP_DEFLATED)
        return held.getvalue()
    out, listed, at = [], [], 0
    for name, (_, data) in zip(names, members, strict=True):
        n = len(data)
        c = zlib.compressobj(-1, zlib.DEFLATED, -max(9, min(15, (n + 262).bit_length())), max(1, min(8, n.bit_length() - 6)))
        packed = c.compress(data) + c.flush()
        same = struct.pack("<5H3L2H", 20, 0 if name.isascii() else 0x800, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(data), len(packed), n, len(name), 0)
        out += [b"PK\x03\x04", same, name, packed]
        listed += [b"PK\x01\x02\x14\x03", same, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), name]
        at += 30 + len(name) + len(packed)
    directory = b"".join(listed)
    return b"".join([*out, directory, struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, len(names), len(names), len(directory), at, 0)])


def member_type(path: str) -> str:
    """xml (case counts), media, font or other."""
    low = path.lower()
    if path.endswith((".xml", ".rels")):
        return "xml"
    if low.endswith((".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".emf", ".wmf", ".svg")):
        return "media"
    return "font" if low.endswith((".ttf", ".otf", ".fntdata", ".odttf")) else "other"


def _stored(kind: str, data: bytes, level: int) -> tuple[str, bytes]:
    """(codec, bytes): images as gradients if they are some and come back byte for byte, all else by zstd."""
    if kind in ("media", "image"):
        try:
            packed = gradients.compress(data)
            if gradients.decompress(packed) == data:
                return "procedural_gradient", packed
        except gradients.Unsuitable:
            pass
    return "zstd", _zstd(level).compress(data)


def pack(form: str, parts: list[dict], level: int = 19) -> bytes:
    """parts: path, type, data, and what else JSON can hold; of equal data only the first is stored."""
    seen: set[bytes] = set()
    items, hashes, blobs = [], [], []
    for p in parts:
        h = hashlib.sha256(p["data"]).digest()
        item = {k: v for k, v in p.items() if k != "data"}
        if h in seen:
            item["codec"] = "reference"
        else:
            seen.add(h)
            item["codec"], blob = _stored(p["type"], p["data"], level)
            item["size"] = len(blob)
            blobs.append(blob)
        items.append(item)
        hashes.append(h)
    head = _zstd(level).compress(json.dumps({"format": form, "parts": items}, separators=(",", ":")).encode())
    return b"".join([MARK, len(head).to_bytes(8, "big"), head, *hashes, *blobs])


def _opened(packed: bytes) -> tuple[str, list[dict], memoryview]:
    """(format, parts with hash, at and size, what is stored) of either form."""
    if packed[: len(MARK)] != MARK:
        raw = _unzstd(packed)
        n = int.from_bytes(raw[:8], "big")
        head = json.loads(raw[8 : 8 + n])
        return head["format"], head["parts"], memoryview(raw)[8 + n :]
    start = len(MARK) + 8
    n = start + int.from_bytes(packed[len(MARK) : start], "big")
    head, rest = json.loads(_unzstd(packed[start:n])), memoryview(packed)[n:]
    at = 0
    for i, p in enumerate(head["parts"]):
        p["hash"] = rest[32 * i : 32 * i + 32].hex()
        if p["codec"] != "reference":
            p["at"] = at
            at += p["size"]
    return head["format"], head["parts"], rest[32 * len(head["parts"]) :]


def unpack(packed: bytes) -> tuple[str, list[dict]]:
    """(format, parts with their data); a reference has the data of the first part with its hash."""
    form, parts, blobs = _opened(packed)
    store: dict[str, bytes] = {}
    for p in parts:
        if p["codec"] != "reference":
            blob = blobs[p["at"] : p["at"] + p["size"]]
            store[p["hash"]] = gradients.decompress(bytes(blob)) if p["codec"] == "procedural_gradient" else _unzstd(blob)
    return form, [p | {"data": store[p["hash"]]} for p in parts]


def duplicates(packed: bytes) -> dict[str, list[str]]:
    """hash: the paths that refer to it."""
    found: dict[str, list[str]] = {}
    for p in unpack(packed)[1]:
        if p["codec"] == "reference":
            found.setdefault(p["hash"], []).append(p["path"])
    return found


def office_compress(data: bytes) -> bytes:
    """An office archive as a bundle of its members."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z, memoryview(data) as view:
            names = {i.filename for i in z.infolist()}
            form = next((kind for kind, marker in MARKERS if marker in names), None)
            if form is None:
                raise Unsuitable("not an office document")
            parts = [{"path": i.filename, "type": member_type(i.filename), "data": member(z, view, i)} for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError) as e:
        raise Unsuitable(f"not a readable archive: {e}") from e
    return pack(form, parts)


def office_decompress(packed: bytes) -> bytes:
    """An archive with the same members in the same order, deflated anew: equal in content, not in bytes."""
    return zipped([(p["path"], p["data"]) for p in unpack(packed)[1]])


_STREAM = re.compile(rb"stream\r?\n")
_LEVELS = (6, 9, 1, 2, 3, 4, 5, 7, 8)


def pdf_compress(data: bytes, level: int = 19) -> bytes:
    """A PDF whose deflated streams are stored plain, if deflating them again gives the same bytes; one zstd frame over all. It comes back byte for byte."""
    if not data.startswith(b"%PDF-"):
        raise Unsuitable("not a PDF")
    pieces, marks, done = [], [], 0
    for m in _STREAM.finditer(data):
        at = m.end()
        if at < done or data[at : at + 1] != b"\x78":
            continue
        d = zlib.decompressobj()
        try:
            plain = d.decompress(data[at:])
        except zlib.error:
            continue
        if not d.eof:
            continue
        packed = data[at : len(data) - len(d.unused_data)]
        found = next((n for n in _LEVELS if zlib.compress(plain, n) == packed), None)
        if found is not None:
            pieces += [data[done:at], plain]
            marks.append((at - done, len(plain), found))
            done = at + len(packed)
    head = json.dumps(marks, separators=(",", ":")).encode()
    return _zstd(level).compress(len(head).to_bytes(8, "big") + head + b"".join(pieces) + data[done:])


def pdf_decompress(packed: bytes) -> bytes:
    raw = memoryview(_unzstd(packed))
    n = int.from_bytes(raw[:8], "big")
    out, at = [], 8 + n
    for before, size, level in json.loads(bytes(raw[8 : 8 + n])):
        out += [raw[at : at + before], zlib.compress(raw[at + before : at + before + size], level)]
        at += before + size
    return b"".join([*out, raw[at:]])
