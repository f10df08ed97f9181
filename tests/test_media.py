"""Raster files, gradients, bundles, PDF files with places, and learned codecs."""

import hashlib
import io
import json
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfold.operators import bundles, codecs, gradients, images, neural, positions, raster, residuals, verify
from sparkfold.sources import archives, pdf


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_raster_round_trip(channels):
    px = np.random.default_rng(channels).integers(0, 256, (9, 7, channels)).astype(np.uint8)
    for kind in ("PNG", "BMP") if channels > 2 else ("PNG",):
        assert raster.read(raster.write(kind, px))[0] == kind and (raster.read(raster.write(kind, px))[1] == px).all()
    assert raster.rgba(px).shape == (9, 7, 4)


def filtered(px):
    """A PNG whose lines use all five filters in turn."""
    h, w, n = px.shape
    flat, lines = px.reshape(h, -1).astype(int), []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * n, int)
        left = np.concatenate((np.zeros(n, int), flat[y][:-n]))
        corner = np.concatenate((np.zeros(n, int), up[:-n]))
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0 * up, left, up, (left + up) // 2, paeth][y % 5]
        lines.append(bytes([y % 5]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    whole = raster.write("PNG", px)
    at = whole.index(b"IDAT") - 4
    return whole[:at] + raster._chunk(b"IDAT", zlib.compress(b"".join(lines))) + raster._chunk(b"IEND", b"")


def test_png_filters_and_refusals():
    px = np.random.default_rng(5).integers(0, 256, (11, 6, 3)).astype(np.uint8)
    assert (raster.read(filtered(px))[1] == px).all()
    for bad in (b"", b"GIF89a", raster.write("PNG", px)[:40], raster.PNG + b"junk", b"BM" + bytes(60)):
        with pytest.raises(raster.Unreadable):
            raster.read(bad)


def test_near_lossless():
    px = np.full((4, 4, 3), 100, np.uint8)
    near, far = px.copy(), px.copy()
    near[1, 2, 0], far[1, 2, 0] = 102, 103
    png = [raster.write("PNG", p) for p in (px, near, far)]
    assert verify.sameness(png[0], png[0]) == "bytes" and verify.sameness(png[0], png[1]) == "pixels"
    assert verify.sameness(png[0], png[2]) is None and verify.sameness(b"a", b"b") is None
    assert verify.sameness(png[0], raster.write("PNG", px[:2])) is None and verify.sameness(raster.write("BMP", px), raster.write("BMP", near)) is None


@pytest.mark.parametrize("kind,angle", [("PNG", 0), ("PNG", 90), ("BMP", 0), ("BMP", 90)])
def test_gradient_codec(kind, angle):
    px = gradients.render({"width": 200, "height": 100, "angle": angle, "start": [0, 10, 250], "stop": [255, 10, 3]})
    data = raster.write(kind, px)
    packed = gradients.compress(data)
    back = gradients.decompress(packed)
    assert len(packed) < 500 and (raster.read(back)[1] == px).all()
    assert codecs.attempt(codecs.codec("procedural_gradient"), data, 0)["lossless"] == (kind == "PNG" or back == data)
    noisy = px.copy()
    noisy[50, 100] += 3
    with pytest.raises(gradients.Unsuitable):
        gradients.compress(raster.write(kind, noisy))
    with pytest.raises(gradients.Unsuitable):
        gradients.compress(b"text")


def test_image_measures_agree(spark):
    """The measures of a decoded file are those of its pixel table."""
    rng = np.random.default_rng(7)
    made = {0: rng.integers(0, 256, (40, 60, 3)), 1: np.tile(np.arange(60)[None, :, None] * 4, (40, 1, 3)), 2: np.full((1, 1, 3), 9), 3: np.repeat(rng.integers(0, 2, (33, 1, 1)) * 255, 57, 1).repeat(3, 2)}
    rows = [(i, x, y, *map(int, px[y, x])) for i, px in made.items() for y in range(px.shape[0]) for x in range(px.shape[1])]
    table = images.features(spark.createDataFrame(rows, "img_id int, x int, y int, r int, g int, b int"))
    want = {r["img_id"]: r.asDict() for r in table.collect()}
    for i, px in made.items():
        got = images.measure(px.astype(np.uint8))
        for k, v in want[i].items():
            assert k == "img_id" or abs(got[k] - v) < 2e-6, (i, k)
    files = spark.createDataFrame([(i, bytearray(raster.write("PNG", px.astype(np.uint8)))) for i, px in made.items()] + [(9, bytearray(b"no image"))], "img_id int, content binary")
    found = {r["img_id"]: r["content_type"] for r in images.classified(files.withColumn("f", images.file_features("content")), "f").collect()}
    assert found[1] == "gradient" and found[9] is None


def office(**extra):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "<w>" + "text " * 500 + "</w>")
        for k, v in extra.items():
            z.writestr(f"word/media/{k}.png", v)
    return b.getvalue()


def test_office_bundle():
    ramp = raster.write("PNG", gradients.render({"width": 64, "height": 64, "angle": 0, "start": [0, 0, 0], "stop": [255, 255, 255]}))
    data = office(a=ramp, b=ramp, c=random.Random(1).randbytes(300))
    packed = bundles.office_compress(data)
    back = zipfile.ZipFile(io.BytesIO(bundles.office_decompress(packed)))
    first = zipfile.ZipFile(io.BytesIO(data))
    assert back.namelist() == first.namelist() and all(back.read(n) == first.read(n) for n in first.namelist())
    form, parts = bundles.unpack(packed)
    assert form == "DOCX" and {p["path"]: p["codec"] for p in parts}["word/media/b.png"] == "reference"
    assert list(bundles.duplicates(packed).values()) == [["word/media/b.png"]] and len(packed) < len(data)
    for bad in (b"no zip", b"PK\x03\x04broken"):
        with pytest.raises(bundles.Unsuitable):
            bundles.office_compress(bad)
    plain = io.BytesIO()
    zipfile.ZipFile(plain, "w").writestr("a.txt", "x")
    with pytest.raises(bundles.Unsuitable):
        bundles.office_compress(plain.getvalue())


def test_office_bundle_stores_no_part_twice_packed():
    """The parts are compressed already and lie in the bundle as they are; bundles of the first form, packed twice, are still read."""
    data = office(c=random.Random(2).randbytes(3000))
    packed = bundles.office_compress(data)
    form, parts = bundles.unpack(packed)
    blobs = [bundles._zstd(19).compress(p["data"]) for p in parts]
    assert packed.endswith(b"".join(blobs)) and all(hashlib.sha256(p["data"]).hexdigest() == p["hash"] for p in parts)
    head = json.dumps({"format": form, "parts": [{k: p[k] for k in ("path", "type", "hash", "codec", "at", "size")} for p in parts]}).encode()
    old = bundles._zstd(19).compress(len(head).to_bytes(8, "big") + head + b"".join(blobs))
    assert bundles.unpack(old) == (form, parts) and bundles.office_decompress(old) == bundles.office_decompress(packed)


@pytest.mark.parametrize("size", [0, 1, 7, 128, 129, 250, 5000, 70_000, 1 << 20])
def test_zipped(size):
    noise = random.Random(size).randbytes(size)
    members = [("[Content_Types].xml", b"<a/>"), ("wörd/ä.xml", noise), ("wide.xml", noise[:300] * (size // 100)), ("odd\0name", b"x" * size)]
    for some in ([], members[:3], members):
        back = zipfile.ZipFile(io.BytesIO(bundles.zipped(some)))
        assert back.testzip() is None and back.namelist() == [n.split("\0")[0] for n, _ in some]
        assert [back.read(i) for i in back.infolist()] == [d for _, d in some]


def test_members_are_read_as_zipfile_reads_them():
    """Plain deflated members are read without zipfile; stored, renamed and broken ones and those after a prefix give what it gives."""
    plain = bundles.zipped([("word/document.xml", b"text " * 900), ("wörd/ä.xml", b""), ("b.bin", bytes(range(256)))])
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w") as z:
        z.writestr("a.txt", b"stored")
        z.writestr("b.txt", b"deflated" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("c.txt", b"bz" * 99, compress_type=zipfile.ZIP_BZIP2)

    def outcome(read):
        try:
            return read()
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
            return type(e)

    rng, broken = random.Random(5), 0
    cases = [plain, stored.getvalue(), b"prefix" * 20 + plain]
    for _ in range(300):
        data = bytearray(plain)
        data[rng.randrange(len(plain) - 22)] ^= 1 << rng.randrange(8)
        cases.append(bytes(data))
    for data in cases:
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, NotImplementedError, UnicodeDecodeError):
            continue
        for info in z.infolist():
            want = outcome(lambda: z.read(info))
            assert outcome(lambda: bundles.member(z, data, info)) == want
            broken += isinstance(want, type)
    assert broken > 20

    class Unread(zipfile.ZipFile):
        def read(self, *a):
            raise AssertionError("the slow way")

    z = Unread(io.BytesIO(plain))
    assert [bundles.member(z, plain, i) for i in z.infolist()] == [b"text " * 900, b"", bytes(range(256))]


def test_zip_components_in_few_batches(spark):
    """Many files of few parts leave Python together, each part beside the id of its file; large ones don't."""
    files = [(i, bundles.zipped([("a.xml", b"%d" % i), ("b.bin", b"")]) if i % 3 else b"no zip") for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in files]), pa.array([d for _, d in files], pa.binary())], names=["id", "content"])
    assert [b.num_rows for b in archives._read([batch], archives.zip_parts)] == [500]
    large = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([bundles.zipped([("a", bytes(5 << 20))])] * 2, pa.binary())], names=["id", "content"])
    assert [b.num_rows for b in archives._read([large], archives.zip_parts)] == [1, 1, 0]
    found = archives.zip_components(spark.createDataFrame([(i, bytearray(d)) for i, d in files], "id long, content binary"))
    rows = {(r["id"], r["ord"]): (r["path"], r["data"], r["error"] is None) for r in found.collect()}
    assert len(rows) == 500 and all(rows[i, 0] == ("a.xml", b"%d" % i, True) and rows[i, 1] == ("b.bin", b"", True) for i in range(300) if i % 3) and rows[0, 0] == (None, None, False)


def document():
    gray, colour = bytes(range(12)), bytes(36)
    page = pdf.Page(1, 612, 792, 0, [pdf.Element("image", [50, 100, 250, 300], 0, gray, "Im0", 4, 3), pdf.Element("image", [0, 0, 10, 20], 1, colour, "Im1", 4, 3), pdf.Element("text", [0, 0, 1, 1], 100, b"Hello (World) \\ end")])
    return [page, pdf.Page(2, 300, 400, 90), pdf.Page(3, 300.5, 400, 0, [pdf.Element("image", [5, 5, 9, 9], 0, gray, "Im0", 4, 3)])]


def test_pdf_write_and_read():
    data, drawn, notes = pdf.write(document())
    again = list(pdf.pages(data))
    assert drawn == 3 and notes == []
    assert [(p.width, p.height, p.rotation, len(p.elements)) for p in again] == [(612, 792, 0, 3), (300, 400, 90, 0), (300.5, 400, 0, 1)]
    for a, b in zip(document(), again, strict=True):
        for x, y in zip(a.elements, b.elements, strict=True):
            assert (x.type, x.data, x.z) == (y.type, y.data, y.z) and (x.type == "text" or (x.box, x.name, x.width, x.height) == (y.box, y.name, y.width, y.height))
    packed = bundles.pdf_compress(data)
    assert bundles.pdf_decompress(packed) == data
    assert bundles.pdf_decompress(bundles.pdf_compress(b"%PDF-1.4\nstream\nx\x9cbroken\nendstream")) == b"%PDF-1.4\nstream\nx\x9cbroken\nendstream"
    with pytest.raises(bundles.Unsuitable):
        bundles.pdf_compress(b"x")
    with pytest.raises(pdf.Unreadable):
        list(pdf.pages(b"%PDF-1.4 trailer << /Encrypt 5 0 R >>"))


def test_placements():
    content = b"q 10 0 0 20 5 6 cm /A Do q 2 0 0 2 1 1 cm /B Do Q /C Do Q /D Do x y cm"
    assert pdf.placements(content) == {"A": [10, 0, 0, 20, 5, 6], "B": [2, 0, 0, 2, 1, 1], "C": [10, 0, 0, 20, 5, 6], "D": [1, 0, 0, 1, 0, 0]}
    assert pdf.placements(content, compose=True)["B"] == [20, 0, 0, 40, 15, 26]
    assert pdf.box_of([-10, 0, 0, -20, 5.555, 6], 1, 1) == [5.55 if round(5.555, 2) == 5.55 else 5.56, 6, round(15.555, 2), 26] and pdf.box_of(None, 7, 8) == [0, 0, 7, 8]


def test_object_streams():
    """Pages that stand in a compressed object stream, with sizes and resources inherited from their parent."""
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 200 100] >>"), (3, b"<< /Type /Page /Parent 2 0 R >>"), (4, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 50 60] /Rotate 90 >>")]
    head, body = b"", b""
    for n, x in inner:
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    stream = zlib.compress(head + body)
    data = b"%%PDF-1.5\n9 0 obj << /Type /ObjStm /N 4 /First %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (len(head), stream)
    assert [(p.width, p.height, p.rotation) for p in pdf.pages(data)] == [(200, 100, 0), (50, 60, 90)]


def test_positions_and_reconstruction(spark):
    files = spark.createDataFrame([("d", bytearray(pdf.write(document())[0])), ("bad", bytearray(b"x"))], "id string, content binary")
    rows = positions.layout(files)
    assert [r["error"] for r in rows.where("error IS NOT NULL").collect()] == ["not a PDF"]
    rows = rows.where("error IS NULL")
    bundle = positions.bundle(rows)
    back = positions.unbundle(bundle)
    keep = ("id", "page", "type", "z_order", "name", "x0", "y0", "x1", "y1", "width", "height", "hash")
    assert sorted(map(repr, back.select(*keep).collect())) == sorted(map(repr, rows.select(*keep).collect()))
    store = positions.contents(rows)
    made = positions.reconstruct(back, store).first()
    assert (made["page_count"], made["images_total"], made["images_placed"], made["accuracy"], made["notes"]) == (3, 3, 3, "exact", [])
    assert [(p.width, len(p.elements)) for p in pdf.pages(bytes(made["pdf"]))] == [(612, 3), (300, 0), (300.5, 1)]
    lacking = positions.reconstruct(back, store.where(F.col("hash") != pdf.Element("image", [], 0, bytes(36)).hash)).first()
    assert lacking["accuracy"] == "approximate" and lacking["images_placed"] == 2 and len(lacking["notes"]) == 1 and lacking["notes"][0].startswith("page 1: image")
    nothing = positions.reconstruct(back, store.limit(0)).first()
    assert nothing["accuracy"] == "page-level" and nothing["page_count"] == 3


def test_pdf_parts_in_a_bundle():
    parts = [{"path": n, "type": t, "data": d} for n, t, d in archives.pdf_parts(pdf.write(document())[0])]
    form, back = bundles.unpack(bundles.pack("PDF", parts))
    assert form == "PDF" and [(p["path"], p["data"]) for p in back] == [(p["path"], p["data"]) for p in parts]
    assert sum(p["codec"] == "reference" for p in back) == 1  # the gray image occurs twice


class Halves(neural.NeuralCodec):
    """A stand-in for a model: half of every value."""

    def load(self):
        self.loads = getattr(self, "loads", 0) + 1

    def encode(self, image):
        return image // 2, image.shape

    def decode(self, latent):
        return (latent[0] * 2).reshape(latent[1]).astype(np.uint8)

    def to_bytes(self, latent):
        return bytes([*latent[1]]) + latent[0].astype(np.uint8).tobytes()

    def from_bytes(self, data):
        return np.frombuffer(data[3:], np.uint8), tuple(data[:3])

    def version(self):
        return getattr(self, "v", "1")


def test_learned_codecs(tmp_path):
    px = np.random.default_rng(3).integers(0, 256, (12, 10, 3)).astype(np.uint8)
    c = Halves("medical")
    packed = c.compress(raster.write("PNG", px))
    assert (raster.read(c.decompress(packed))[1] == px).all() and c.loads == 1 and (c.name, c.estimate) == ("neural_medical", 35.0)
    c.v = "2"
    with pytest.raises(neural.ModelMissing):
        c.decompress(packed)
    with pytest.raises(ValueError):
        Halves("cooking")
    assert neural.find_model("medical", "encoder", [tmp_path]) is None and not neural.models_available("medical", [tmp_path])
    (tmp_path / "medical_encoder.onnx").write_bytes(b"x")
    assert neural.find_model("medical", "encoder", [tmp_path]) == tmp_path / "medical_encoder.onnx" and not neural.models_available("medical", [tmp_path])
    (tmp_path / "medical_decoder.onnx").write_bytes(b"x")
    assert neural.available_domains([tmp_path]) == ["medical"]
    with pytest.raises(neural.ModelMissing, match="encoder and decoder"):
        neural.get("satellite").compress(raster.write("PNG", px))
    with pytest.raises(KeyError):
        neural.get("cooking")
    assert c.applies("medical", 0.7) and not c.applies("ui_screenshot", 0.9)


def test_resizing():
    px = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (residuals.resize(px, 4, 4) == px).all() and residuals.resize(px, 8, 2).shape == (8, 2, 3)
    flat = np.full((5, 7, 3), 99, np.uint8)
    assert (residuals.resize(flat, 11, 3) == 99).all()
