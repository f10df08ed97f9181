"""Format detection: leading bytes, structure, archive members, then the file name's extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfold.functions import content as C

#: (name, offset, hex of the signature, MIME type, category, version); the first that matches counts.
SIGNATURES = (
    ("PNG", 0, "89504E470D0A1A0A", "image/png", "image", None),
    ("JPEG", 0, "FFD8FF", "image/jpeg", "image", None),
    ("GIF", 0, "474946383761", "image/gif", "image", "87a"),
    ("GIF", 0, "474946383961", "image/gif", "image", "89a"),
    ("WEBP", 0, "52494646", "image/webp", "image", None),
    ("BMP", 0, "424D", "image/bmp", "image", None),
    ("TIFF", 0, "49492A00", "image/tiff", "image", None),
    ("TIFF", 0, "4D4D002A", "image/tiff", "image", None),
    ("JPEG2000", 0, "0000000C6A50", "image/jp2", "image", None),
    ("PDF", 0, "255044462D", "application/pdf", "document", None),
    ("ZIP_OFFICE", 0, "504B0304", "application/zip", "document", None),
    ("OLE", 0, "D0CF11E0", "application/msword", "document", None),
    ("DICOM", 128, "4449434D", "application/dicom", "medical", None),
    ("GZIP", 0, "1F8B", "application/gzip", "archive", None),
    ("BZ2", 0, "425A68", "application/bzip2", "archive", None),
    ("7ZIP", 0, "377ABCAF271C", "application/7z", "archive", None),
    ("RAR", 0, "526172211A07", "application/rar", "archive", None),
)
#: extension to (name, MIME type, category)
EXTENSIONS = {
    f".{row[0]}": tuple(row[1:])
    for row in map(
        str.split,
        """
        txt  TXT   text/plain        text
        csv  CSV   text/csv          data
        json JSON  application/json  data
        xml  XML   application/xml   data
        svg  SVG   image/svg+xml     image
        dwg  DWG   image/vnd.dwg     cad
        dxf  DXF   image/vnd.dxf     cad
        dcm  DICOM application/dicom medical
        """.strip().splitlines(),
    )
}
OFFICE = {"word/document.xml": ("DOCX", "wordprocessingml.document"), "xl/workbook.xml": ("XLSX", "spreadsheetml.sheet"), "ppt/presentation.xml": ("PPTX", "presentationml.presentation")}
CATEGORIES = ("image", "document", "cad", "medical", "audio", "video", "archive", "data", "text", "unknown")


def _format(kind: Column | str, mime: Column | str, category: Column | str, version: Column | str | None, confidence: float) -> Column:
    def c(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(c(kind).alias("type"), c(mime).alias("mime_type"), c(category).alias("category"), c(version).cast("string").alias("version"), F.lit(confidence).alias("confidence"))


def by_magic(header: Column) -> Column:
    """The format whose signature the header has; null if none."""
    found = None
    for kind, at, magic, mime, category, version in SIGNATURES:
        hit = F.hex(C.slice_of(header, at, len(magic) // 2)) == magic
        if kind == "WEBP":  # a RIFF container is an image only if it says so
            webp = F.hex(C.slice_of(header, 8, 4)) == "57454250"
            value = F.when(webp, _format("WEBP", mime, category, None, 0.95)).otherwise(_format("RIFF", "audio/x-wav", "audio", None, 0.95))
        elif kind == "PDF":
            value = _format(kind, mime, category, F.decode(C.slice_of(header, 5, 3), "US-ASCII"), 0.95)
        else:
            value = _format(kind, mime, category, version, 0.95)
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found


def by_structure(header: Column) -> Column:
    """DWG by its release tag; null otherwise."""
    tag = F.hex(C.slice_of(header, 0, 6))
    return F.when(tag.isin("414331303135", "414331303234"), _format("DWG", "image/vnd.dwg", "cad", F.decode(C.slice_of(header, 0, 6), "US-ASCII"), 0.98))


def by_extension(path: Column) -> Column:
    """A guess from the last extension; UNKNOWN at confidence 0 if it says nothing."""
    ext = F.lower(F.regexp_extract(path, r"(?:^|[^/.])(\.[^./]*)$", 1))
    found = None
    for name, (kind, mime, category) in EXTENSIONS.items():
        value = _format(kind, mime, category, None, 0.6)
        found = F.when(ext == name, value) if found is None else found.when(ext == name, value)
    return found.otherwise(_format("UNKNOWN", "application/octet-stream", "unknown", None, 0.0))


def by_members(members: Column) -> Column:
    """What an archive with these member names is: an office document, or just an archive; null without names."""
    found = F.when(members.isNull(), F.lit(None))
    for marker, (kind, mime) in OFFICE.items():
        found = found.when(F.array_contains(members, marker), _format(kind, f"application/vnd.openxmlformats-officedocument.{mime}", "document", None, 0.99))
    return found.otherwise(_format("ZIP", "application/zip", "archive", None, 0.9))


def detect(files: DataFrame, path: str = "path", header: str = "header", members: str | None = None) -> DataFrame:
    """Adds type, mime_type, category, version and confidence. With ``members`` (array of names) archives are looked into."""
    magic = by_magic(F.col(header))
    if members is not None:
        magic = F.when(magic["type"] == "ZIP_OFFICE", F.coalesce(by_members(F.col(members)), magic)).otherwise(magic)
    found = F.coalesce(magic, by_structure(F.col(header)), by_extension(F.col(path)))
    return files.withColumn("_format", found).select("*", "_format.*").drop("_format")
