"""Best-fit packing of documents into token sequences, certified by lower bounds.

A document of n tokens is cut into pieces of at most ``capacity`` tokens; every
token is packed exactly once. Pieces are spread over partitions by a hash, and each
partition is packed by best-fit decreasing.

Certificate. Dual feasible functions map sizes so that any set that fits a bin still
fits it; the mapped total is then a lower bound on the bins. Each partition takes the
largest bound of three families (identity; the threshold functions that raise large
and drop small pieces; the rounding functions u_k) and is optimal if it needs no more
bins than that.

Exchange. Partitions with a gap between bins and bound pool their documents in pairs,
another pairing each round, and rerun best-fit decreasing on the pool. A pool
replaces its partitions' bins only if it needs fewer. At most ROUNDS rounds.

Sequences. Only ids, hashes and sizes are packed. The text of every piece then meets its
place by (id, hash, piece), so a long document is many rows and none is multiplied, and
the pieces of a bin, at most ``capacity`` tokens, become one row.

Defined results
    * null text, or a text without a token: nothing to pack; one row with piece 0,
      0 tokens and null bin.
    * white space inside a piece is kept; pieces of a sequence are parted by SEPARATOR.
    * a text longer than the capacity: as many full pieces as it has, then the rest.
    * null id: packed like any other row.
    * ties: equal sizes are placed in the order of id and piece; best fit takes the
      fullest bin that fits, and of equally full ones the last that became so.
    * repeated rows: each is packed.
    * ids of any type that can be ordered.
    * empty table: an empty result of the same schema.
    * extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, of, sized, small_batches, typed

CAPACITY = 2048
PER_PARTITION = 20_000
ROUNDS = 3
SEPARATOR = "\n\n"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset in it) of each size, and how many bins; sizes are placed from large to small, ties in their order."""
    at = np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set if some bin has r tokens of room
    bins = 0
    for i, s in zip(at.tolist(), sizes[at].tolist(), strict=True):
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b, r = bins, capacity
            bins += 1
        where[i], offset[i] = b, capacity - r
        r -= s
        if r:
            room[r].append(b)
            free |= 1 << r
    return where, offset, bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can undercut: the largest of the dual feasible bounds."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.cumsum(count), np.cumsum(count * x)
    best = -(-int(total[-1]) // capacity)
    # f(x) = 0 below t, x up to capacity - t, capacity above
    t = np.arange(1, capacity // 2 + 1)
    middle = total[capacity - t] - total[t - 1]
    raised = (n[-1] - n[capacity - t]) * capacity
    best = max(best, int((-(-(middle + raised) // capacity)).max(initial=0)))
    # u_k(x) = x / capacity where (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) / k; in units of 1 / (k capacity)
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        u = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((u * count).sum()) // (k * capacity)))
    return best


_PACKED = ("part long, bin long, start long", "hash binary, piece int, size int, bins long, bound long")
_NAMES = ["part", "bin", "start", "id", "hash", "piece", "size", "bins", "bound"]


def _solve(table: pa.Table, capacity: int) -> tuple[pa.Table, np.ndarray, np.ndarray, int, int]:
    table = table.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending")])
    sizes = table.column("size").to_numpy().astype(np.int64)
    where, offset, bins = best_fit_decreasing(sizes, capacity)
    return table, where, offset, bins, lower_bound(sizes, capacity)


def _rows(table: pa.Table, part: pa.Array, where, offset, bins: pa.Array, bound: pa.Array) -> pa.Table:
    return pa.table([part, pa.array(where, pa.int64()), pa.array(offset, pa.int64()), table.column("id"), table.column("hash"), table.column("piece"), table.column("size"), bins, bound], names=_NAMES)


def _same(value: int, n: int) -> pa.Array:
    return pa.array(np.full(n, value, np.int64))


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table, where, offset, bins, bound = _solve(table, capacity)
        return _rows(table, table.column("part"), where, offset, _same(bins, len(table)), _same(bound, len(table)))

    return run


def _repack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        _, first = np.unique(parts, return_index=True)
        before = int(table.column("bins").to_numpy()[first].sum())
        solved, where, offset, bins, bound = _solve(table, capacity)
        if bins >= before:  # nothing gained: the bins stay as they were
            return table.select(_NAMES)
        return _rows(solved, _same(int(parts.min()), len(table)), where, offset, _same(bins, len(table)), _same(bound, len(table)))

    return run


def pieces(docs: DataFrame, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, piece, size) of every row; tokens are maximal runs of characters other than white space."""
    # a letter for each token, then without white space: no string is made for each token
    letters = F.regexp_replace(F.regexp_replace(of(docs, text), r"\S+", "x"), r"\s+", "")
    tokens = F.coalesce(F.length(letters), F.lit(0))
    rows = docs.select(of(docs, doc_id).alias("id"), F.unhex(F.md5(of(docs, text))).alias("hash"), tokens.alias("n"))
    rows = rows.select("id", "hash", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(n - 1) div {capacity}"), F.lit(0)).cast("int"))).alias("piece"))
    return rows.select("id", "hash", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"))


def packed(items: DataFrame, capacity: int, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """(part, bin, start, id, hash, piece, size, bins, bound) of items (id, hash, piece, size) with 0 < size <= capacity."""
    schema = typed(_PACKED[0], items.schema["id"], _PACKED[1])
    parts = max(1, -(-items.count() // per_partition))
    spread = items.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    now = cut(spread.groupBy("part").applyInArrow(_pack(capacity), schema))
    for turn in range(rounds):
        gaps = now.where("bins > bound").select("part").distinct()
        # one row for each partition with a gap, not for each document
        place = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(turn), "part"), "part"))
        pools = cut(gaps.withColumn("pool", F.floor((place - 1) / 2)))
        if pools.count() < 2:
            break
        pools = sized(pools)
        done = now.join(pools, "part", "left_anti")
        again = now.join(pools, "part").groupBy("pool").applyInArrow(_repack(capacity), schema)
        now = cut(done.unionByName(again))
    return now


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, tokens, bin_id, start, part_bins, part_bound, certified) for every piece of every row.

    ``start`` is the piece's first token in its bin; a partition is ``certified`` if
    its number of bins equals its lower bound, so that no packing of it is better.
    """
    return _placed(docs, capacity, doc_id, text, per_partition, rounds).drop("hash")


def _placed(docs: DataFrame, capacity: int, doc_id: str, text: str, per_partition: int, rounds: int) -> DataFrame:
    items = cut(pieces(docs, capacity, doc_id, text))
    found = packed(items.where("size > 0"), capacity, per_partition, rounds)
    bin_id = F.shiftleft("part", 32) + F.col("bin")
    some = found.select(
        F.col("id").alias("doc_id"), "hash", "piece", F.col("size").alias("tokens"), bin_id.alias("bin_id"), "start", F.col("bins").alias("part_bins"), F.col("bound").alias("part_bound"), (F.col("bins") == F.col("bound")).alias("certified")
    )
    none = items.where("size <= 0").select(F.col("id").alias("doc_id"), "hash", "piece", F.lit(0).alias("tokens"), *[F.lit(None).cast("long").alias(c) for c in ("bin_id", "start", "part_bins", "part_bound")], F.lit(True).alias("certified"))
    return some.unionByName(none)


def _texts(capacity: int):
    """(id, hash, text) to (id, hash, piece, text) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, text = [], [], []
            for i, v in enumerate(batch.column(2)):
                data = memoryview(v.as_buffer())
                space = _SPACE[np.frombuffer(data, np.uint8)]
                edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
                begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
                for p, at in enumerate(range(0, len(begin), capacity)):
                    row.append(i)
                    piece.append(p)
                    text.append(bytes(data[begin[at] : end[min(at + capacity, len(begin)) - 1]]))
                if sum(map(len, text)) > 1 << 22 and i + 1 < batch.num_rows:  # about 4 MB leave at a time
                    yield _piece_rows(batch, row, piece, text)
                    row, piece, text = [], [], []
            yield _piece_rows(batch, row, piece, text)
        pa.default_memory_pool().release_unused()

    return run


def _piece_rows(batch: pa.RecordBatch, row: list[int], piece: list[int], text: list[bytes]) -> pa.RecordBatch:
    at = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), pa.array(text, pa.binary()).cast(pa.string())], names=["id", "hash", "piece", "text"])


def sequences(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """(bin_id, tokens, doc_ids, pieces, starts, text, part_bins, part_bound, certified) of every sequence.

    doc_ids, pieces and starts say which piece of which document begins at which token;
    ``text`` is these pieces in order. A document without a token is a row of its own
    with null bin_id and 0 tokens.
    """
    placed = cut(_placed(docs, capacity, doc_id, text, per_partition, rounds))
    rows = small_batches(docs).select(of(docs, doc_id).alias("id"), F.unhex(F.md5(of(docs, text))).alias("hash"), of(docs, text).alias("text")).where("text IS NOT NULL")
    rows = rows.withColumn("_h", F.xxhash64("id", "hash"))
    # of repeated rows one gives the text; the rank limit leaves one in each partition before the shuffle
    again = sized(cut(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")))
    one = rows.join(again, "_h", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("_h", "id", "hash").orderBy(F.lit(0)))).where("_r = 1")
    texts = rows.join(again, "_h", "left_anti").select("id", "hash", "text").unionByName(cut(one.select("id", "hash", "text")))
    # a text of so few characters has one piece, which needs no Python
    short = F.length("text") < 2 * capacity
    one_piece = texts.where(short).select("id", "hash", F.lit(0).alias("piece"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    more = texts.where(~short).mapInArrow(_texts(capacity), typed(texts.schema["id"], "hash binary, piece int, text string"))
    held = one_piece.unionByName(more).toDF("_id", "_hash", "_piece", "text")
    there = held.join(placed.where("bin_id IS NOT NULL"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & (F.col("piece") == F.col("_piece")))
    inside = F.array_sort(F.collect_list(F.struct("start", "doc_id", "piece", "tokens", "text"))).alias("p")
    bins = there.groupBy("bin_id").agg(inside, *[F.first(c).alias(c) for c in ("part_bins", "part_bound", "certified")])
    whole = F.array_join(F.col("p.text"), SEPARATOR).alias("text")
    full = bins.select("bin_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("tokens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.start").alias("starts"), whole, "part_bins", "part_bound", "certified")
    none = placed.where("bin_id IS NULL").select("bin_id", F.lit(0).cast("long").alias("tokens"), F.array("doc_id").alias("doc_ids"), F.array("piece").alias("pieces"), F.array(F.lit(0).cast("long")).alias("starts"), F.lit("").alias("text"), "part_bins", "part_bound", "certified")
    return full.unionByName(none)
