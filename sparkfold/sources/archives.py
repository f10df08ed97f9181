"""Archives and PDF files as component tables, by the standard library only.

Both functions take (id, content) and return (id, ord, path, type, hash, data, error): a
file that can't be read is one row with its error.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.functions.lineage import BATCH_BYTES
from sparkfold.operators import bundles, components

from . import pdf

Part = tuple[str, str, bytes]
#: Parts that leave Python in one batch, unless their bytes are enough before.
BATCH_ROWS = 4096


def zip_parts(data: bytes) -> list[Part]:
    """(path, "", data) of every member; folders and unreadable members are left out."""
    found = []
    with zipfile.ZipFile(io.BytesIO(data)) as z, memoryview(data) as view:
        for info in z.infolist():
            if info.is_dir():
                continue
            try:
                found.append((info.filename, "", bundles.member(z, view, info)))
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                continue
    return found


def pdf_parts(data: bytes) -> list[Part]:
    """Version, size, text and images of each page, text that no page refers to, and fonts of a PDF."""
    o = pdf.objects(data)
    found: list[Part] = [("version", "metadata", data[5:8])]
    for page in pdf.pages(data):
        found.append((f"page {page.number}", "layout", f"{page.width:g}x{page.height:g}".encode()))
        found += [(f"page {page.number}" + (f" {e.name}" if e.name else ""), e.type, e.data) for e in page.elements]
    used = {n for head, _ in o.held.values() for n in o.refs(head, b"/Contents")}
    for number, (head, raw) in sorted(o.held.items()):
        if raw is not None and number not in used and not re.search(rb"/(?:Subtype\s*/Image|Type\s*/(?:ObjStm|XRef|XObject))\b", head):
            if (text := pdf.text_of(raw)).strip():
                found.append((str(number), "text", text))
    for number, (head, _) in sorted(o.held.items()):
        if re.search(rb"/Type\s*/Font\b", head):
            found.append((str(number), "font", (re.search(rb"/BaseFont\s*/([^\s/<>\[\]]+)", head) or [b"", b""])[1]))
    return found


@F.arrow_udf(T.ArrayType(T.StringType()))
def member_names(content: pa.Array) -> pa.Array:
    """The names in an archive; null for what is none."""
    out = []
    for v in content:
        data = v.as_py() if v.is_valid else b""
        try:
            out.append(zipfile.ZipFile(io.BytesIO(data)).namelist() if data[:2] == b"PK" else None)
        except (zipfile.BadZipFile, NotImplementedError):
            out.append(None)
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.BinaryType())
def zip_of(paths: pa.Array, parts: pa.Array) -> pa.Array:
    """An archive of the members with these names and contents."""
    rows = zip(paths.to_pylist(), parts.to_pylist(), strict=True)
    return pa.array([bundles.zipped([(name, data or b"") for name, data in zip(names or [], datas or [], strict=True)]) for names, datas in rows], pa.binary())


SCHEMA = "ord int, path string, type string, hash string, data binary, error string"


_TYPES = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]


def _batch(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]], names=["id", "ord", "path", "type", "hash", "data", "error"])


def _read(batches: Iterator[pa.RecordBatch], read: Callable[[bytes], list[Part]]) -> Iterator[pa.RecordBatch]:
    """The parts of files (id, content): one file at a time in memory, and parts of those before it up to a batch."""
    for batch in batches:
        at, rows, held = [], [], 0
        for i, data in enumerate(batch.column(1)):
            try:
                found = [(n, path, kind, hashlib.sha256(d).hexdigest() if d else "", d, None) for n, (path, kind, d) in enumerate(read(data.as_py() or b""))]
                held += sum(len(r[4]) for r in found)
            except (zipfile.BadZipFile, ValueError) as e:
                found = [(0, None, None, None, None, str(e))]
            rows += found
            at += [i] * len(found)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(batch.column(0), at, rows)
                at, rows, held = [], [], 0
        yield _batch(batch.column(0), at, rows)


def _parts(files: DataFrame, read: Callable[[bytes], list[Part]]) -> DataFrame:
    some = files.select("id", "content")
    return some.mapInArrow(lambda batches: _read(batches, read), T.StructType([some.schema["id"], *T.StructType.fromDDL(SCHEMA).fields]))


def zip_components(files: DataFrame) -> DataFrame:
    found = _parts(files, zip_parts)
    return found.withColumn("type", F.when(F.col("path").isNotNull(), components.member_class(F.col("path"))))


def pdf_components(files: DataFrame) -> DataFrame:
    return _parts(files, pdf_parts)
