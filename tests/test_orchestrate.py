"""Files through profile, selection, verified attempts, containers and back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkfold.__main__ import main
from sparkfold.operators import images, jsoncodec, orchestrate


def table(n, **dump):
    return json.dumps([{"id": i * 3, "name": f"n{i % 5}", "v": i / 7, "ok": i % 2 == 0, "note": None if i % 3 else "é"} for i in range(n)], **dump).encode()


@pytest.mark.parametrize("dump", [{}, {"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}])
def test_json_codec(dump):
    data = table(300, **dump)
    packed = jsoncodec.compress(data)
    assert jsoncodec.decompress(packed) == data and len(packed) * 4 < len(data)


@pytest.mark.parametrize("data", [b"[]", b"x" * 3000, json.dumps({"a": "b" * 3000}).encode(), json.dumps([{"a": 1}] * 5).encode(), table(300).replace(b", ", b" ,", 1), json.dumps([{"a": "x" * 300}] * 9 + [{"b": 1}] * 2).encode()])
def test_json_codec_refuses(data):
    with pytest.raises(jsoncodec.Unsuitable):
        jsoncodec.compress(data)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(0)
    source = tmp_path / "in"
    source.mkdir()
    for name, data in {"t.txt": b"Hello World. " * 5000, "d.json": table(2000), "odd.json": b"{}", "r.bin": rng.randbytes(4096), "empty.txt": b""}.items():
        (source / name).write_bytes(data)
    return source


def test_compress_keeps_the_best(spark, folder):
    from sparkfold.sources import files

    got = {r["name"]: r for r in orchestrate.compress(files.binary(spark, str(folder)), str(folder)).collect()}
    assert got["t.txt"]["strategy"] == "traditional_zstd" and got["d.json"]["strategy"] in ("semantic_json", "traditional_zstd")
    assert got["odd.json"]["strategy"] == "traditional_zstd" and "semantic_json" in got["odd.json"]["errors"][0]
    assert got["d.json"]["tried"] >= 1 and set(got) == {"t.txt", "d.json", "odd.json", "r.bin"}  # the scan leaves out empty files


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["compress", str(folder), str(tmp_path / "c")], spark) == 0
    assert main(["decompress", str(tmp_path / "c"), str(tmp_path / "out")], spark) == 0
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {p.name: p.read_bytes() for p in folder.iterdir() if p.stat().st_size}
    capsys.readouterr()
    assert main(["analyze", str(folder), "--json"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {x["format_type"] for x in lines} == {"TXT", "JSON", "UNKNOWN"} and all(x["hints"][-1] == "traditional_zstd" for x in lines)
    assert main(["analyze", str(folder)], spark) == 0 and "entropy" in capsys.readouterr().out


def test_rendered_gradients_are_found(spark):
    params = spark.createDataFrame([(0, 30, 20, "horizontal", [0, 10, 250], [255, 10, 3]), (1, 9, 33, "vertical", [5, 5, 5], [9, 200, 0])], "img_id int, w int, h int, direction string, start array<int>, stop array<int>")
    px = images.render_gradients(params)
    assert {r["img_id"]: (r["direction"], r["worst"]) for r in images.linear_gradients(px).collect()} == {0: ("horizontal", 0), 1: ("vertical", 0)}
    assert px.groupBy("img_id").agg(F.count("*")).count() == 2


def test_same_names_in_several_folders(spark, tmp_path, capsys):
    """Files of one name in different folders come back where they were; a container that is there already is not written over."""
    source = tmp_path / "in"
    for i, d in enumerate(("", "a", "b/c")):
        (source / d).mkdir(parents=True, exist_ok=True)
        (source / d / "x.txt").write_bytes(b"content of number %d " % i * 50)
    assert main(["compress", str(source), str(tmp_path / "c")], spark) == 0
    assert sorted(p.relative_to(tmp_path / "c").as_posix() for p in (tmp_path / "c").rglob("*.fold")) == ["a/x.txt.fold", "b/c/x.txt.fold", "x.txt.fold"]
    assert main(["decompress", str(tmp_path / "c"), str(tmp_path / "out")], spark) == 0
    for p in source.rglob("*.txt"):
        assert (tmp_path / "out" / p.relative_to(source)).read_bytes() == p.read_bytes()
    with pytest.raises(Exception, match="several containers of one name"):
        main(["compress", str(source), str(tmp_path / "c")], spark)
    broken = tmp_path / "c" / "a" / "x.txt.fold"
    broken.write_bytes(broken.read_bytes()[:-1] + b"?")
    capsys.readouterr()
    assert main(["decompress", str(tmp_path / "c"), str(tmp_path / "again")], spark) == 1
    assert "a/x.txt: the payload has another checksum" in capsys.readouterr().err
    assert sorted(p.relative_to(tmp_path / "again").as_posix() for p in (tmp_path / "again").rglob("*.txt")) == ["b/c/x.txt", "x.txt"]


def test_collection_end_to_end(spark, capsys, tmp_path):
    """The generated collection: a gradient is found and kept as one, a document with its parts is recognised, everything comes back."""
    from sparkfold.operators import raster
    from sparkfold.sources import files

    made = files.collection(spark)
    found = {r["path"]: r for r in orchestrate.analyse(made).collect()}
    assert found["gradient_512.png"]["content_type"] == "gradient" and found["gradient_512.png"]["hints"][0] == "procedural_gradient"
    assert found["report.docx"]["format_type"] == "DOCX" and "semantic_office" in found["report.docx"]["hints"]
    assert found["high_entropy.bin"]["is_random"] and found["high_entropy.bin"]["notes"] and found["text_small.txt"]["image"] is None
    texts = {r["path"]: r["text"] for r in orchestrate.summary(orchestrate.analyse(made)).collect()}
    assert "gradient image of 512 x 512" in texts["gradient_512.png"] and "9.8 KB" in texts["text_small.txt"]
    rows = orchestrate.compress(made)
    kept = {r["name"]: r for r in rows.collect()}
    assert len(kept) == 10 and kept["gradient_512.png"]["strategy"] == "procedural_gradient"
    big = kept["gradient_512.png"]
    assert len(big["payload"]) < 500
    back = {r["name"]: r for r in orchestrate.decompress(rows).collect()}
    content = {r["path"]: bytes(r["content"]) for r in made.collect()}
    assert all(r["verified"] for r in back.values())
    assert all(bytes(back[n]["content"]) == content[n] for n in content if n != "gradient_512.png")
    assert (raster.read(bytes(back["gradient_512.png"]["content"]))[1] == raster.read(content["gradient_512.png"])[1]).all()


def test_memory_and_paths(spark):
    from sparkfold.operators import codecs

    codecs.register_codec(codecs.Codec("greedy", lambda b: b, lambda b: b, "1.0D"))
    from sparkfold.operators import selection

    rules, selection.RULES = selection.RULES, (*selection.RULES, ("greedy", "true", "1.0D", 1))
    selection.MEMORY_MB["greedy"] = 2000
    try:
        row = orchestrate.analyse(spark.createDataFrame([("a/b.txt", bytearray(b"abc"))], "path string, content binary"))
        assert row.select(orchestrate.strategies(512).alias("s")).first()["s"] == ["traditional_zstd"]
        assert row.select(orchestrate.strategies(4096).alias("s")).first()["s"] == ["greedy", "traditional_zstd"]
    finally:
        selection.RULES = rules
        del selection.MEMORY_MB["greedy"], codecs.CODECS["greedy"]
    paths = spark.createDataFrame([("file:/data/in/a/x.txt",), ("file:/data/in/x.txt",), ("hdfs://n:1/data/in/x",)], "p string")
    got = [r[0] for r in paths.select(orchestrate.relative(F.col("p"), "file:/data/in")).collect()]
    assert got == ["a/x.txt", "x.txt", "n:1/data/in/x"]
    assert [r[0] for r in paths.select(orchestrate.relative(F.col("p"), None)).collect()][0] == "data/in/a/x.txt"
