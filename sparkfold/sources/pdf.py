"""PDF files by the standard library: objects, pages with their elements and places, and a writer.

Read are plain objects, object streams and deflated streams; encrypted files are refused. A
page's elements are its images, placed by the matrix in force when they are drawn, and its
text, which covers the page.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

WIDTH, HEIGHT = 612.0, 792.0
TEXT_Z = 100
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_TEXT = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\\.|[^\]])*)\]\s*TJ", re.DOTALL)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.DOTALL)
_REF = re.compile(rb"\s*(\d+)\s+\d+\s+R\b")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"(": b"(", b")": b")", b"\\": b"\\"}


class Unreadable(ValueError):
    """Not a PDF, or one that isn't read here."""


def _plain(raw: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), raw, flags=re.DOTALL)


def text_of(content: bytes) -> bytes:
    """The strings that a content stream shows, in order."""
    return b" ".join(_plain(a) if a else b"".join(_plain(s) for s in _STRING.findall(b)) for a, b in _TEXT.findall(content))


def placements(content: bytes, compose: bool = False) -> dict[str, list[float]]:
    """name: the matrix [a, b, c, d, e, f] in force where it is drawn; of several drawings the last counts.

    q and Q save and bring back the matrix. ``cm`` sets it; with ``compose`` it is multiplied, as in nested drawings.
    """
    now, stack, out = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [], {}
    tokens = content.decode("latin-1").split()
    for i, t in enumerate(tokens):
        if t == "q":
            stack.append(now)
        elif t == "Q" and stack:
            now = stack.pop()
        elif t == "cm" and i >= 6:
            try:
                m = [float(x) for x in tokens[i - 6 : i]]
            except ValueError:
                continue
            if compose:
                a, b, c, d, e, f = m
                p, q, r, s, u, v = now
                m = [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + u, e * q + f * s + v]
            now = m
        elif t == "Do" and i:
            out[tokens[i - 1].lstrip("/")] = now
    return out


def box_of(matrix: list[float] | None, width: float, height: float) -> list[float]:
    """Where the unit square lands, at 2 digits; without a matrix the whole page."""
    if matrix is None:
        return [0.0, 0.0, width, height]
    a, _, _, d, e, f = matrix
    return [round(e, 2), round(f, 2), round(e + abs(a), 2), round(f + abs(d), 2)]


@dataclass
class Objects:
    """The objects of a file by their numbers: (dictionary, stream or None)."""

    held: dict[int, tuple[bytes, bytes | None]]

    def value(self, body: bytes, key: bytes) -> bytes | None:
        """What follows a key: a dictionary, an array, or all up to the next key; references are followed once."""
        m = re.search(key + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return None
        rest = body[m.end() :]
        if ref := _REF.match(rest):
            return self.held.get(int(ref[1]), (b"", None))[0]
        for begin, end in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(begin):
                depth = at = 0
                while at < len(rest):
                    if rest.startswith(begin, at):
                        depth, at = depth + 1, at + len(begin)
                    elif rest.startswith(end, at):
                        depth, at = depth - 1, at + len(end)
                        if not depth:
                            return rest[:at]
                    else:
                        at += 1
        return re.split(rb"[/>]", rest, maxsplit=1)[0].strip() if not rest.startswith(b"/") else re.match(rb"/[^\s/<>\[\]]*", rest)[0]

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key names, one or an array of them."""
        m = re.search(key + rb"(?![A-Za-z0-9])\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def objects(data: bytes) -> Objects:
    if not data.startswith(b"%PDF-"):
        raise Unreadable("not a PDF")
    if re.search(rb"/Encrypt\b", data):
        raise Unreadable("the PDF is encrypted")
    held: dict[int, tuple[bytes, bytes | None]] = {}
    for number, body in _OBJECT.findall(data):
        stream = _STREAM.search(body)
        raw, head = (stream[1], body[: stream.start()]) if stream else (None, body)
        if raw is not None and b"/FlateDecode" in head:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                raw = None
        held[int(number)] = (head, raw)
    for head, raw in list(held.values()):
        if raw is not None and re.search(rb"/Type\s*/ObjStm\b", head):
            n, first = (re.search(k + rb"\s+(\d+)", head) for k in (rb"/N", rb"/First"))
            if n and first:
                spots = [int(x) for x in raw[: int(first[1])].split()[: 2 * int(n[1])]]
                starts = [int(first[1]) + x for x in spots[1::2]] + [len(raw)]
                for number, lo, hi in zip(spots[::2], starts, starts[1:], strict=False):
                    held.setdefault(number, (raw[lo:hi], None))
    return Objects(held)


def _page_order(o: Objects) -> list[tuple[int, bytes]]:
    """(number, dictionary with what it inherits) of the pages as the page tree has them; by number if there is none."""
    found: list[tuple[int, bytes]] = []
    seen: set[int] = set()

    def walk(n: int, inherited: bytes) -> None:
        body = o.held.get(n, (b"", None))[0]
        if n in seen or not body:
            return
        seen.add(n)
        if re.search(rb"/Type\s*/Page\b", body):
            found.append((n, body + inherited))
            return
        own = b"".join(b" " + k + b" " + v for k in (b"/MediaBox", b"/Resources", b"/Rotate") if (v := o.value(body, k)))
        for kid in o.refs(body, b"/Kids"):
            walk(kid, own + inherited)

    for body, _ in list(o.held.values()):
        if re.search(rb"/Type\s*/Catalog\b", body):
            for n in o.refs(body, b"/Pages"):
                walk(n, b"")
    return found or [(n, body) for n, (body, _) in sorted(o.held.items()) if re.search(rb"/Type\s*/Page\b", body)]


@dataclass
class Element:
    type: str
    box: list[float]
    z: int
    data: bytes
    name: str = ""
    width: int = 0
    height: int = 0
    hash: str = ""

    def __post_init__(self):
        self.hash = self.hash or hashlib.sha256(self.data).hexdigest()


@dataclass
class Page:
    number: int
    width: float = WIDTH
    height: float = HEIGHT
    rotation: int = 0
    elements: list[Element] = field(default_factory=list)


def _number(raw: bytes | None, default: float = 0) -> float:
    m = re.match(rb"\s*(-?[\d.]+)", raw or b"")
    return float(m[1]) if m else default


def pages(data: bytes, compose: bool = False) -> Iterator[Page]:
    """The pages with their images, in the order of the resources, then their text."""
    o = objects(data)
    for n, (_, body) in enumerate(_page_order(o), 1):
        sides = [float(x) for x in re.findall(rb"-?[\d.]+", o.value(body, b"/MediaBox") or b"")]
        page = Page(n, *((sides[2] - sides[0], sides[3] - sides[1]) if len(sides) == 4 else (WIDTH, HEIGHT)), rotation=int(_number(o.value(body, b"/Rotate"))))
        content = b"\n".join(o.held.get(r, (b"", None))[1] or b"" for r in o.refs(body, b"/Contents"))
        drawn = placements(content, compose)
        xobjects = o.value(o.value(body, b"/Resources") or b"", b"/XObject") or b""
        for name, ref in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", xobjects):
            head, raw = o.held.get(int(ref), (b"", None))
            if raw and re.search(rb"/Subtype\s*/Image\b", head):
                called = name.decode("latin-1")
                page.elements.append(Element("image", box_of(drawn.get(called), page.width, page.height), len(page.elements), raw, called, int(_number(o.value(head, b"/Width"))), int(_number(o.value(head, b"/Height")))))
        text = text_of(content)
        if text.strip():
            page.elements.append(Element("text", box_of(None, page.width, page.height), TEXT_Z, text))
        yield page


def _image(e: Element) -> tuple[bytes, bytes] | None:
    """(dictionary entries, stream) of an image that can be drawn: JPEG, or as many bytes as its size asks for."""
    if e.data[:3] == b"\xff\xd8\xff":
        return b"/ColorSpace /DeviceRGB /Filter /DCTDecode", e.data
    for n, space in ((1, b"/DeviceGray"), (3, b"/DeviceRGB"), (4, b"/DeviceCMYK")):
        if e.width > 0 and e.height > 0 and len(e.data) == n * e.width * e.height:
            return b"/ColorSpace " + space + b" /Filter /FlateDecode", zlib.compress(e.data)
    return None


def write(content: list[Page]) -> tuple[bytes, int, list[str]]:
    """(file, images that were drawn, notes): pages of their sizes with their elements in the order of z."""
    out: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids, drawn, notes = [], 0, []
    for page in content:
        ops, names = [], []
        for e in sorted(page.elements, key=lambda e: e.z):
            x0, y0, x1, y1 = e.box
            if e.type == "text":
                shown = re.sub(rb"([\\()])", rb"\\\1", e.data).replace(b"\n", b"\\n").replace(b"\r", b"\\r")
                ops.append(b"BT /F1 10 Tf 36 %d Td (%s) Tj ET" % (int(page.height) - 36, shown))
                continue
            image = _image(e)
            if x1 <= x0 or y1 <= y0 or image is None:
                notes.append(f"page {page.number}: image {e.name or e.hash[:8]} has no {'extent' if x1 <= x0 or y1 <= y0 else 'readable pixels'}")
                continue
            entries, stream = image
            out.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 %s /Length %d >>\nstream\n%s\nendstream" % (e.width, e.height, entries, len(stream), stream))
            called = (e.name or f"Im{len(names)}").encode("latin-1", "replace")
            names.append(b"/%s %d 0 R" % (called, len(out)))
            ops.append(b"q %s 0 0 %s %s %s cm /%s Do Q" % (*(f"{v:.2f}".encode() for v in (x1 - x0, y1 - y0, x0, y0)), called))
            drawn += 1
        stream = zlib.compress(b"\n".join(ops))
        out.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
        out.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Rotate %d /Resources << /Font << /F1 3 0 R >> /XObject << %s >> >> /Contents %d 0 R >>" % (page.width, page.height, page.rotation, b" ".join(names), len(out)))
        kids.append(len(out))
    out[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    out[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    parts, at, spots = [b"%PDF-1.4\n"], 9, []
    for n, body in enumerate(out, 1):
        spots.append(at)
        parts.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
        at += len(parts[-1])
    parts.append(b"xref\n0 %d\n0000000000 65535 f \n%s" % (len(out) + 1, b"".join(b"%010d 00000 n \n" % s for s in spots)))
    parts.append(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(out) + 1, at))
    return b"".join(parts), drawn, notes
