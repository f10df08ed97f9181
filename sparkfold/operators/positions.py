"""Where the elements of PDF files are, as tables, and files made of such tables again."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.sources import pdf

from .components import accuracy

_ROWS = "page int, type string, z_order int, name string, x0 double, y0 double, x1 double, y1 double, width double, height double, rotation int, hash string, data binary, error string"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 6, pa.int32(), pa.string(), pa.binary(), pa.string()]


def layout(files: DataFrame, id_col: str = "id", content: str = "content", compose: bool = False) -> DataFrame:
    """(id, page, type, ...) of files: a row of type page for each page, then one for each image and text; a file that can't be read is one row with its error."""

    def rows(data: bytes) -> Iterator[tuple]:
        try:
            for p in pdf.pages(data, compose):
                yield p.number, "page", None, None, 0.0, 0.0, p.width, p.height, p.width, p.height, p.rotation, None, None, None
                for e in p.elements:
                    yield p.number, e.type, e.z, e.name or None, *e.box, float(e.width), float(e.height), p.rotation, e.hash, e.data, None
        except pdf.Unreadable as e:
            yield *[None] * 13, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in enumerate(batch.column(1)):  # one file at a time in memory
                found = list(zip(*rows(v.as_py() or b""), strict=True)) or [[]] * len(_NAMES)
                ids = batch.column(0).slice(i, 1).take(pa.array([0] * len(found[0]), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(found, _TYPES, strict=True)]], names=["id", *_NAMES])

    some = files.select(F.col(id_col).alias("id"), F.col(content).alias("content"))
    return some.mapInArrow(run, T.StructType([T.StructField("id", some.schema["id"].dataType), *T.StructType.fromDDL(_ROWS).fields]))


def elements(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, page, type, z_order, name, x0, y0, x1, y1, width, height, hash) of layout rows, of one type or all."""
    return rows.where(F.col("type") != "page" if kind is None else F.col("type") == kind).select("id", "page", "type", "z_order", "name", "x0", "y0", "x1", "y1", "width", "height", "hash")


def page_sizes(rows: DataFrame) -> DataFrame:
    return rows.where("type = 'page'").select("id", "page", "width", "height", "rotation")


def contents(rows: DataFrame) -> DataFrame:
    """(hash, data), each once."""
    return rows.where("hash IS NOT NULL").groupBy("hash").agg(F.first("data").alias("data"))


def extent(row: str = "") -> tuple[Column, Column]:
    """Width and height of the boxes of elements, at 2 digits."""
    return F.round(F.col(f"{row}x1") - F.col(f"{row}x0"), 2), F.round(F.col(f"{row}y1") - F.col(f"{row}y0"), 2)


def with_content(found: DataFrame, store: DataFrame) -> DataFrame:
    """Elements beside their content from a store (hash, data); ``note`` says which one it lacks."""
    both = found.join(store.select("hash", "data"), "hash", "left")
    missing = F.format_string("page %d: %s %s is not in the store", F.col("page"), F.col("type"), F.substring("hash", 1, 8))
    return both.withColumn("note", F.when(F.col("data").isNull(), missing))


def bundle(rows: DataFrame) -> DataFrame:
    """(id, bundle): pages and elements as JSON, elements by their z."""
    one = F.struct("z_order", "type", "name", "x0", "y0", "x1", "y1", "width", "height", "hash")
    own = elements(rows).groupBy("id", "page").agg(F.array_sort(F.collect_list(one)).alias("elements"))
    each = page_sizes(rows).join(own, ["id", "page"], "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "width", "height", "rotation", "elements"))).alias("pages"))
    return each.select("id", F.to_json(F.struct(F.lit("2.0").alias("format_version"), F.size("pages").alias("page_count"), "pages")).alias("bundle"))


def unbundle(bundles: DataFrame) -> DataFrame:
    """Layout rows without data of bundles (id, bundle)."""
    e = "array<struct<z_order:int,type:string,name:string,x0:double,y0:double,x1:double,y1:double,width:double,height:double,hash:string>>"
    pages = bundles.select("id", F.explode(F.from_json("bundle", f"pages array<struct<page:int,width:double,height:double,rotation:int,elements:{e}>>")["pages"]).alias("p"))
    head = pages.select("id", "p.page", F.lit("page").alias("type"), F.lit(None).cast("int").alias("z_order"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p.width").alias("x1"), F.col("p.height").alias("y1"), "p.width", "p.height", "p.rotation", F.lit(None).cast("string").alias("hash"))
    each = pages.select("id", "p.page", "p.rotation", F.explode("p.elements").alias("e"))
    return head.unionByName(each.select("id", "page", "e.type", "e.z_order", "e.name", "e.x0", "e.y0", "e.x1", "e.y1", "e.width", "e.height", "rotation", "e.hash"))


def reconstruct(rows: DataFrame, store: DataFrame) -> DataFrame:
    """(id, pdf, page_count, images_total, images_placed, accuracy, notes): a file for each id, from layout rows without data and a store (hash, data).

    All of a document meets in one group, as its file does in one row.
    """
    whole = with_content(rows.where("type <> 'page'").drop("data"), store).unionByName(page_sizes(rows).withColumn("type", F.lit("page")), allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        pages: dict[int, pdf.Page] = {}
        total, notes = 0, []
        found = sorted(table.to_pylist(), key=lambda r: (r["type"] != "page", r["page"], r["z_order"] or 0, r["name"] or ""))
        for r in found:
            if r["type"] == "page":
                pages[r["page"]] = pdf.Page(r["page"], r["width"], r["height"], r["rotation"] or 0)
                continue
            total += r["type"] == "image"
            if r["note"] is not None:
                notes.append(r["note"])
                continue
            page = pages.setdefault(r["page"], pdf.Page(r["page"]))
            page.elements.append(pdf.Element(r["type"], [r[k] for k in ("x0", "y0", "x1", "y1")], r["z_order"], r["data"], r["name"] or "", int(r["width"] or 0), int(r["height"] or 0), r["hash"]))
        made, placed, more = pdf.write([pages.get(n) or pdf.Page(n) for n in range(1, max(pages, default=0) + 1)])
        one = pa.table({"pdf": pa.array([made], pa.binary()), "page_count": pa.array([max(pages, default=0)], pa.int32()), "images_total": pa.array([total], pa.int64()), "images_placed": pa.array([placed], pa.int64()), "notes": pa.array([json.dumps(notes + more)])})
        return one.add_column(0, "id", table.column("id").slice(0, 1).combine_chunks())

    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("pdf binary, page_count int, images_total long, images_placed long, notes string").fields])
    done = whole.groupBy("id").applyInArrow(run, kind)
    return done.select("id", "pdf", "page_count", "images_total", "images_placed", accuracy(F.col("images_placed"), F.col("images_total")).alias("accuracy"), F.from_json("notes", "array<string>").alias("notes"))
