"""The compressed container as a Spark data source, one row for each file.

Layout: a 512-byte header (4 magic bytes, then version, original size, compressed size
and metadata length as little-endian 32- and 64-bit numbers), JSON metadata, payload.
Metadata always has the strategy and the payload's SHA-256, so files can be decoded and
checked. ``spark.dataSource.register(Container)`` makes it known as ``container``.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = bytes.fromhex("41495231")
STREAM_MAGIC = bytes.fromhex("41495253545245414D31")
HEADER, VERSION = 512, 1
SUFFIX, HIDDEN = ".fold", ".writing"
_FORM = "<4sIQQQ"
SCHEMA = "name string, version int, original_size long, compressed_size long, strategy string, metadata map<string,string>, payload binary, error string"
_ARROW = pa.schema([("name", pa.string()), ("version", pa.int32()), ("original_size", pa.int64()), ("compressed_size", pa.int64()), ("strategy", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string())])
#: Bytes and rows of a batch that is read, and how many files the driver moves at once.
BATCH_BYTES, BATCH_ROWS, MOVES = 4 << 20, 10_000, 16
#: Files a task: the fewest and the most, and between them as many as give TASKS tasks.
FEWEST, MOST, TASKS = 64, 2048, 128


class FormatError(ValueError):
    """Not a container, or a damaged one."""


def pack(payload: bytes, original_size: int, strategy: str, metadata: dict[str, str] | None = None) -> bytes:
    meta = json.dumps((metadata or {}) | {"strategy_name": strategy, "sha256": hashlib.sha256(payload).hexdigest()}, sort_keys=True).encode()
    return struct.pack(_FORM, MAGIC, VERSION, original_size, len(payload), len(meta)).ljust(HEADER, b"\0") + meta + payload


def unpack(data: bytes) -> dict:
    """The parts of a container; FormatError for a wrong magic, version, length or checksum."""
    if len(data) < HEADER or data[:4] != MAGIC:
        raise FormatError("no container")
    _, version, original, compressed, length = struct.unpack_from(_FORM, data)
    if version != VERSION:
        raise FormatError(f"version {version} is unknown")
    payload = data[HEADER + length :]
    if len(payload) != compressed:
        raise FormatError("the payload is cut off")
    try:
        meta = {k: str(v) for k, v in json.loads(data[HEADER : HEADER + length]).items()}
    except ValueError as e:
        raise FormatError("the metadata can't be read") from e
    if meta.get("sha256", "") not in ("", hashlib.sha256(payload).hexdigest()):
        raise FormatError("the payload has another checksum")
    return {"version": version, "original_size": original, "compressed_size": compressed, "strategy": meta.get("strategy_name", meta.get("strategy")), "metadata": meta, "payload": payload}


def safe(name: str) -> str:
    """A name that stays in its folder: parts that lead out of it are refused."""
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise FormatError(f"{name!r} is no name for a file")
    return "/".join(parts)


def validate(data: bytes) -> bool:
    try:
        unpack(data)
    except FormatError:
        return False
    return True


def pack_stream(windows: list[bytes], manifest: dict) -> bytes:
    """The stream layout: magic, manifest length as 8 big-endian bytes, manifest as JSON, windows."""
    text = json.dumps(manifest, sort_keys=True).encode()
    return STREAM_MAGIC + len(text).to_bytes(8, "big") + text + b"".join(windows)


def unpack_stream(data: bytes) -> tuple[dict, bytes]:
    n = len(STREAM_MAGIC)
    if data[:n] != STREAM_MAGIC:
        raise FormatError("no stream")
    length = int.from_bytes(data[n : n + 8], "big")
    if len(data) < n + 8 + length:
        raise FormatError("the manifest is cut off")
    return json.loads(data[n + 8 : n + 8 + length]), data[n + 8 + length :]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), str(Path(path).absolute())


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """The driver lists names; tasks open ``filesPerTask`` files each, wherever they are, and hold about BATCH_BYTES or one file of them. Unless it is given, it grows with the files, so that millions don't make tasks by ten thousands."""

    def __init__(self, options: dict):
        self.folder, self.per_task = options["path"], int(options.get("filesPerTask", 0))

    def partitions(self) -> list[InputPartition]:
        store, base = opened(self.folder)
        if store.get_file_info(base).type == fs.FileType.File:
            paths = [base]
        else:
            paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.path.endswith(SUFFIX))
        n = self.per_task or max(FEWEST, min(MOST, -(-len(paths) // TASKS)))
        return [_Files(paths[i : i + n]) for i in range(0, len(paths), n)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[6] or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, partition: _Files) -> Iterator[tuple]:
        store, base = opened(self.folder)
        for p in partition.paths:
            name = p.removeprefix(base).lstrip("/").removesuffix(SUFFIX) or Path(p).stem
            try:
                with store.open_input_stream(p) as f:
                    c = unpack(f.read())
                yield (name, c["version"], c["original_size"], c["compressed_size"], c["strategy"], list(c["metadata"].items()), c["payload"], None)
            except FormatError as e:
                yield (name, None, None, None, None, None, None, str(e))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Done(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _Writer(DataSourceWriter):
    """Tasks write under temporary names; the commit renames, so a task that runs twice leaves one file. Two rows of one name, or a name that is there already, are an error and leave the folder as it was."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, base = opened(self.folder)
        store.create_dir(f"{base}/{HIDDEN}", recursive=True)
        moves = []
        for r in rows:
            temporary = f"{base}/{HIDDEN}/{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(pack(bytes(r["payload"]), r["original_size"], r["strategy"], dict(r["metadata"] or {})))
            moves.append((temporary, f"{base}/{safe(r['name'])}{SUFFIX}"))
        return _Done(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = opened(self.folder)
        moves = [x for m in messages if m for x in m.moves]
        there = [f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.path.endswith(SUFFIX)]
        names = [b for _, b in moves]
        clash = {n for n, times in Counter(names).items() if times > 1}
        if not self.overwrite:
            clash |= set(there) & set(names)
        if clash:
            self.abort(messages)
            raise FileExistsError(f"several containers of one name: {', '.join(sorted(clash)[:5])}")
        if self.overwrite:
            for old in there:
                store.delete_file(old)
        for folder in {b.rsplit("/", 1)[0] for b in names}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVES) as threads:  # each waits for the file system; the first error is raised
            for lo in range(0, len(moves), BATCH_ROWS):
                list(threads.map(lambda m: store.move(*m), moves[lo : lo + BATCH_ROWS]))
        self._clean(store, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = opened(self.folder)
        for m in messages:
            for a, _ in m.moves if m else []:
                store.delete_file(a)
        self._clean(store, base)

    @staticmethod
    def _clean(store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{HIDDEN}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{HIDDEN}")


class Container(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)
