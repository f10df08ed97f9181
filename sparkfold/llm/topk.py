"""Exact top-k search by the threshold algorithm: a stated set of queries against all vectors.

A block of vectors has two sorted lists for each dimension, by value downwards (for
queries with a positive weight there) and upwards (negative weight). The algorithm
reads all lists in step. After depth t the unseen vectors of a block have, in every
dimension, no more than what its list holds at t, so no unseen vector scores more than

    sum over d of q[d] * list_d[t]           and no more than the best vector of at most
                                             the block's largest norm within these limits.

A query is done with a block as soon as this bound is below its kth score so far.

The vectors of a block are kept in the order in which any of the lists first shows
them, so what all queries see between two depths is one slice, and its scores are one
matrix product.

Blocks hold vectors that lie near each other: a tree of cuts across the axis of the
largest spread, fitted on at most SAMPLE vectors of a width class, gives every vector
its leaf, and a leaf is as many blocks as its count asks for. A summary of each block
(centre, radius, least and greatest values, largest norm) bounds what it can give a query
before it is read. Queries of neighbouring leaves form query blocks, which first search
the SEEDS blocks that promise most and then only those whose bound beats the kth score
of some query. What is paired for that are query blocks and summaries, CHUNK of them a
row; the vectors themselves are joined for the pairs that are left. Nothing that grows
is broadcast or collected.

On vectors without structure in high dimensions no bound falls until nearly all vectors
are seen; the search is then a blocked matrix product and as exact.

Scores are inner products in double precision, added in the order of the dimensions
and rounded to 9 digits; a vector isn't its own neighbour. Single precision, on numbers
scaled to 1, only filters; its tolerance follows from the width and the norms.

Defined results
    * null, empty or non-finite vectors, null elements, null ids: neither query nor
      answer; no rows.
    * vectors of different lengths: shorter ones are filled with zeros. Vectors of about
      one length share blocks, so a few very long ones don't widen the others.
    * ties: the smaller id ranks first.
    * repeated ids: one query each and one answer each; rows of one id never answer each other.
    * ids of any type that can be ordered.
    * fewer than k others: as many rows as there are.
    * scores beyond the range of a double are infinite.
    * empty table, or no query: an empty result.
    * extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bounded, cut, numbered, of, sized

BLOCK = 2048
#: Bytes of the vectors of a block at most, but for single vectors.
BLOCK_BYTES = 16 << 20
#: Vectors of a width class that its tree is fitted on, at most so many bytes; levels of the tree; least vectors of the sample in a leaf.
SAMPLE, SAMPLE_BYTES, LEVELS, LEAF = 4096, 64 << 20, 12, 8
#: Blocks that a query block searches before it looks at bounds; summaries in a row; neighbouring blocks that travel together.
SEEDS, CHUNK, TOGETHER = 2, 1024, 8
#: Depths of the sorted lists at which the bound is tested.
DEPTHS = (4, 32, 128, 512)
#: Least tolerance of the filters; the error of single precision comes on top of it.
SLACK = 1e-4
DIGITS = 9
_BLOCKED = "block long, width int, ids binary, vectors binary, first binary, high binary, low binary, norm double, centre array<double>, radius double, least array<double>, greatest array<double>"
_FOUND = "q long, row int, vec_id long, neighbour_id long, score double"


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; squares don't overflow."""
    top = np.abs(x).max(1, initial=0, keepdims=True)
    return top[:, 0] * np.sqrt(np.square(np.divide(x, top, out=np.zeros_like(x), where=top > 0)).sum(1))


def rounded(score: np.ndarray) -> np.ndarray:
    """At DIGITS digits; numbers too large to have so many stay."""
    most = 2.0**52 / 10**DIGITS
    return np.where(np.abs(score) < most, np.round(np.clip(score, -most, most), DIGITS), score)


@dataclass
class Tree:
    """A full binary tree of cuts; node i has the children 2 i + 1 and 2 i + 2."""

    axes: np.ndarray
    cuts: np.ndarray
    levels: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        w = self.axes.shape[1] if self.levels else 0
        for _ in range(self.levels):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x[:, :w], self.axes[node]) >= self.cuts[node])
        return node - ((1 << self.levels) - 1)


def fit_tree(x: np.ndarray, levels: int) -> Tree:
    """Each node cuts its part of the sample at the median along about the axis of its largest spread."""
    levels = max(0, min(levels, int(np.log2(max(len(x) / LEAF, 1)))))
    axes, cuts = np.zeros(((1 << levels) - 1, x.shape[1])), np.zeros((1 << levels) - 1)
    parts = {0: np.arange(len(x))}
    for node in range((1 << levels) - 1):
        part = parts.pop(node)
        y = x[part] - x[part].mean(0) if len(part) else np.zeros((1, x.shape[1]))
        top = np.abs(y).max(initial=0)
        y = y / top if top > 0 else y
        v = y[norms(y).argmax()]
        for _ in range(8):
            v = y.T @ (y @ v)
            size = np.linalg.norm(v)
            v = v / size if size > 0 else np.eye(1, x.shape[1])[0]
        at = x[part] @ v
        axes[node], cuts[node] = v, np.median(at) if len(at) else 0
        right = at >= cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return Tree(axes, cuts, levels)


def promise(x: np.ndarray, size: np.ndarray, centre: np.ndarray, radius: np.ndarray, least: np.ndarray, greatest: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Queries x blocks: no vector of a block with this summary scores more; size: the queries' norms."""
    w = min(x.shape[1], centre.shape[1])
    x, centre, least, greatest = (a[:, :w] for a in (x, centre, least, greatest))
    ball = x @ centre.T + size[:, None] * radius
    box = np.maximum(x, 0) @ greatest.T + np.minimum(x, 0) @ least.T
    return np.minimum(np.minimum(ball, box), size[:, None] * norm)


def arrange(x: np.ndarray, depths: tuple[int, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, slice ends, list values downwards and upwards at each depth): the sorted lists of a block, as the search uses them."""
    n = len(x)
    up = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(up)
    np.put_along_axis(rank, up, np.arange(n)[:, None], 0)
    seen = np.minimum(rank.min(1), (n - 1 - rank).min(1))  # the depth at which some list shows it
    order = np.argsort(seen, kind="stable")
    at = [t for t in depths if t < n]
    ends = np.searchsorted(seen[order], at, side="left") if at else np.zeros(0, np.int64)
    values = np.take_along_axis(x, up, 0)
    high = np.array([values[n - 1 - t] for t in at]).reshape(len(at), x.shape[1])
    low = np.array([values[t] for t in at]).reshape(len(at), x.shape[1])
    return order, np.append(ends, n), high, low


def unseen_bound(q: np.ndarray, high: np.ndarray, low: np.ndarray, norm: float) -> np.ndarray:
    """The most that a vector y with low <= y <= high and |y| <= norm can score with each query; -inf if there is none."""
    size = np.abs(q)
    limit = np.where(q >= 0, high, -low)
    plain = (size * limit).sum(1)
    # water filling: y = level * q, cut at the limits, as long as the norm allows
    ratio = np.where(size > 0, limit / np.where(size > 0, size, 1), np.inf)
    order = np.argsort(ratio, axis=1)
    s, b = np.take_along_axis(size, order, 1), np.take_along_axis(limit, order, 1)
    zero = np.zeros((len(q), 1))
    used = np.concatenate((zero, np.cumsum(b * b, 1)), 1)[:, :-1]
    gain = np.concatenate((zero, np.cumsum(s * b, 1)), 1)[:, :-1]
    rest = np.cumsum((s * s)[:, ::-1], 1)[:, ::-1]
    level = np.sqrt(np.maximum(norm * norm - used, 0) / np.where(rest > 0, rest, 1))
    fits = (level <= np.take_along_axis(ratio, order, 1)) & (rest > 0)
    first = fits.argmax(1)
    rows = np.arange(len(q))
    filled = gain[rows, first] + level[rows, first] * rest[rows, first]
    negative = np.minimum(limit, 0)
    none = (negative * negative).sum(1) > norm * norm * (1 + 1e-9)
    return np.where(none, -np.inf, np.where(fits.any(1), np.minimum(plain, filled), plain))


class Best:
    """The k best answers so far of the queries of one block; only scores of at least ``floor`` count."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.norms = norms(x)
        self.top = float(np.abs(x).max(initial=0)) or 1.0
        self.single = (x / self.top).astype(np.float32)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.score = np.full((len(ids), k), -np.inf)
        self.answer = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.seen = 0

    def limit(self, rows: np.ndarray) -> np.ndarray:
        """What an answer must reach."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def slack(self, rows: np.ndarray, norm: float) -> np.ndarray:
        """What single precision may add to the difference of two scores of each query with vectors of at most this norm."""
        return SLACK + (self.x.shape[1] + 3) * 2.0**-23 * self.norms[rows] * norm

    def offer(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, own: bool) -> None:
        """Score these vectors for these queries and keep what is among the k best. own: some of them may be the queries themselves."""
        w = min(self.x.shape[1], x.shape[1])
        top = float(np.abs(x).max(initial=0)) or 1.0
        rough = (self.single[rows, :w] @ (x[:, :w] / top).astype(np.float32).T).astype(np.float64) * self.top * top
        self.seen += rough.size
        if own:
            rough[self.ids[rows][:, None] == ids] = -np.inf
        kth = self.limit(rows)
        if len(ids) > self.k and np.isneginf(kth).any():  # what these vectors offer themselves is a limit too
            kth = np.maximum(kth, np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        slack = self.slack(rows, float(norms(x).max(initial=0)))
        a, b = np.nonzero(~(rough < (kth - slack)[:, None]) & (rough > -np.inf))
        if not len(a):
            return
        exact = np.empty(len(a))
        for lo in range(0, len(a), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            exact[at] = np.cumsum(self.x[rows[a[at]], :w] * x[b[at], :w], axis=1)[:, -1]
        touched = np.unique(a)
        who = np.concatenate((a, np.repeat(touched, self.k)))
        score = np.concatenate((rounded(exact), self.score[rows[touched]].reshape(-1)))
        answer = np.concatenate((ids[b], self.answer[rows[touched]].reshape(-1)))
        order = np.lexsort((answer, -score, who))
        who, score, answer = who[order], score[order], answer[order]
        begin = np.flatnonzero(np.diff(who, prepend=-1))
        place = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
        top = place < self.k
        self.score[rows[who[top]], place[top]] = score[top]
        self.answer[rows[who[top]], place[top]] = answer[top]

    def search(self, ids: np.ndarray, x: np.ndarray, ends: np.ndarray, high: np.ndarray, low: np.ndarray, norm: float, own: bool) -> None:
        """The threshold algorithm over one block."""
        rows, begin = np.arange(len(self.ids)), 0
        for t, end in enumerate(ends):
            if end > begin:
                self.offer(rows, ids[begin:end], x[begin:end], own)
            begin = end
            if t < len(high):
                w = min(self.x.shape[1], high.shape[1])
                bound = unseen_bound(self.x[rows, :w], high[t, :w], low[t, :w], norm)
                rows = rows[~(bound < self.limit(rows) - self.slack(rows, norm))]
                if not len(rows):
                    return

    def batch(self, block: int) -> pa.RecordBatch:
        found = self.answer < np.iinfo(np.int64).max
        row = np.repeat(np.arange(len(self.ids)), found.sum(1))
        columns = [pa.array(np.full(len(row), block, np.int64)), pa.array(row, pa.int32()), pa.array(self.ids[row]), pa.array(self.answer[found], pa.int64()), pa.array(self.score[found])]
        return pa.RecordBatch.from_arrays(columns, names=["q", "row", "vec_id", "neighbour_id", "score"])


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    lens = np.diff(vectors.offsets.to_numpy())
    x = np.zeros((len(lens), width))
    x[np.repeat(np.arange(len(lens)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = vectors.flatten().to_numpy()
    return x


def _one(columns: dict[str, tuple[object, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array([v], t) for k, (v, t) in columns.items()})


def _sorted(table: pa.Table, widths: dict[int, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(width, ids in order, vectors) of a group of rows of one width class."""
    width = widths[table.column("wide")[0].as_py()]
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return width, ids[order], _matrix(table.column("v").combine_chunks(), width)[order]


def _block(widths: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        width, ids, x = _sorted(table, widths)
        order, ends, high, low = arrange(x)
        ids, x = ids[order], x[order]
        scale = 1 + 1e-9
        centre = x.mean(0)
        doubles = pa.list_(pa.float64())
        return _one({
            "block": (table.column("block")[0].as_py(), pa.int64()), "width": (width, pa.int32()), "ids": (ids.tobytes(), pa.binary()), "vectors": (x.tobytes(), pa.binary()), "first": (ends.astype(np.int64).tobytes(), pa.binary()),
            "high": (high.tobytes(), pa.binary()), "low": (low.tobytes(), pa.binary()), "norm": (float(norms(x).max() * scale), pa.float64()), "centre": (centre, doubles), "radius": (float(norms(x - centre).max() * scale), pa.float64()), "least": (x.min(0), doubles), "greatest": (x.max(0), doubles),
        })

    return run


def _queries(widths: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        width, ids, x = _sorted(table, widths)
        return _one({"q": (table.column("qblock")[0].as_py(), pa.int64()), "q_width": (width, pa.int32()), "q_ids": (ids.tobytes(), pa.binary()), "q_vectors": (x.tobytes(), pa.binary())})

    return run


def _promising(seeds: int | None):
    """Pairs (q, block, best): with ``seeds``, so many blocks of a row of summaries that promise a query block most; otherwise all whose promise beats some query's kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q, width, x, floor = (batch.column(i)[r].as_py() for i in range(4))
                x = np.frombuffer(x).reshape(-1, width)
                parts = batch.column(4)[r].values
                block = parts.field("block").to_numpy()
                centre, least, greatest = (parts.field(n).flatten().to_numpy().reshape(len(block), -1) for n in ("centre", "least", "greatest"))
                norm, size = parts.field("norm").to_numpy(), norms(x)
                most = promise(x, size, centre, parts.field("radius").to_numpy(), least, greatest, norm)
                total = most.mean(0)
                if seeds:
                    at = np.argsort(-total, kind="stable")[:seeds]
                else:
                    slack = SLACK + (x.shape[1] + 3) * 2.0**-23 * size[:, None] * norm
                    at = np.flatnonzero((~(most < np.frombuffer(floor)[:, None] - slack)).any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int64)), pa.array(block[at]), pa.array(total[at])], names=["q", "block", "best"])

    return run


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, Best] | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                q, q_width, floor, width = (batch.column(i)[r].as_py() for i in (0, 1, 4, 5))
                if now is None or now[0] != q:
                    if now is not None:
                        yield now[1].batch(now[0])
                    ids, x = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                    now = q, Best(np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, q_width), k, None if floor is None else np.frombuffer(floor))
                ids, x, first, high, low, norm = (batch.column(i)[r].as_py() for i in range(6, 12))
                now[1].search(np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, width), np.frombuffer(first, np.int64), np.frombuffer(high).reshape(-1, width), np.frombuffer(low).reshape(-1, width), norm, True)
        if now is not None:
            yield now[1].batch(now[0])

    return run


def _floors(k: int):
    """(q, floor): the kth score of each query of a block after the first search, -inf if it has fewer."""

    def run(table: pa.Table) -> pa.Table:
        row, score = table.column("row").to_numpy(), table.column("score").to_numpy()
        out = np.full(len(np.frombuffer(table.column("q_ids")[0].as_py(), np.int64)), -np.inf)
        order = np.lexsort((-score, row))
        row, score = row[order], score[order]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        out[row[place == k - 1]] = score[place == k - 1]
        return _one({"q": (table.column("q")[0].as_py(), pa.int64()), "floor": (out.tobytes(), pa.binary())})

    return run


def _placed(rows: DataFrame, block: int) -> tuple[DataFrame, dict[int, int]]:
    """(rows (id, v, asks) with wide, block and qblock; the width of each class): a class is a power of two of the length, at most 31 in all."""
    rows = rows.withColumn("wide", F.ceil(F.log2(F.size("v"))).cast("int"))
    classes = {r[0]: (r[1], r[2]) for r in rows.groupBy("wide").agg(F.count(F.lit(1)), F.max(F.size("v"))).collect()}
    widths = {c: w for c, (_, w) in classes.items()}
    size = {c: max(1, min(block, BLOCK_BYTES // (8 * w))) for c, w in widths.items()}
    trees = {}
    for c, (n, w) in classes.items():
        most = min(SAMPLE, SAMPLE_BYTES // (8 * w))
        levels = min(LEVELS, int(np.ceil(np.log2(max(n / size[c], 1)))), int(np.log2(max((32 << 20) // (8 * w), 1))))
        if levels and most >= 2 * LEAF:
            chosen = sized(bounded(rows.where(F.col("wide") == c).select(F.col("id").alias("_id"), F.lit(0).alias("_key")), most))
            some = rows.where(F.col("wide") == c).join(chosen, F.col("id") == F.col("_id"), "left_semi").select("id", "v").orderBy("id").limit(2 * most)
            x = _matrix(pa.array([r[1] for r in some.collect()], pa.list_(pa.float64())), w)
            trees[c] = fit_tree(x, levels)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.column(3).to_numpy()
            leaf = np.zeros(len(wide), np.int32)
            for c in np.unique(wide).tolist():
                at = np.flatnonzero(wide == c)
                if c in trees:
                    leaf[at] = trees[c].leaf(_matrix(batch.column(1).take(pa.array(at)), widths[c]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "asks", "wide", "leaf"])

    found = cut(rows.select("id", "v", "asks", "wide").mapInArrow(leaves, "id long, v array<double>, asks boolean, wide int, leaf int"))
    # at most 31 << LEVELS rows: the blocks of each leaf and of its queries
    spots, base, q, room = [], 0, 0, 0
    for c, leaf, n, asks in sorted(map(tuple, found.groupBy("wide", "leaf").agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).collect())):
        blocks, asked = -(-n // size[c]), max(1, -(-asks // size[c]))
        if asked > 1 or asks > room or (spots and spots[-1][0] != c):
            q, room = q + 1, size[c]
        spots.append((c, leaf, base, blocks, q, asked))
        room -= min(asks, room)
        base, q = base + blocks, q + asked - 1
        if asked > 1:
            room = 0
    table = rows.sparkSession.createDataFrame(spots, "wide int, leaf int, base long, blocks int, qbase long, qblocks int")
    hashed = F.xxhash64("id", "v")
    placed = found.join(F.broadcast(table), ["wide", "leaf"])
    return placed.select("id", "v", "asks", "wide", (F.col("base") + F.pmod(hashed, F.col("blocks"))).alias("block"), (F.col("qbase") + F.pmod(hashed, F.col("qblocks"))).alias("qblock")), widths


def block_pairs(queries: DataFrame, made: DataFrame, seeds: int | None) -> DataFrame:
    """(q, block, best) of query blocks (q, q_width, q_vectors, floor) and the blocks that may answer them; see _promising."""
    summary = F.struct("block", "centre", "radius", "least", "greatest", "norm")
    chunks = made.groupBy("width", F.expr(f"block div {CHUNK}").alias("c")).agg(F.collect_list(summary).alias("parts")).select("parts")
    both = queries.select("q", "q_width", "q_vectors", "floor").hint("shuffle_replicate_nl").crossJoin(chunks)  # query blocks, and rows of CHUNK summaries
    return both.mapInArrow(_promising(seeds), "q long, block long, best double")


def search(vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, score): the k vectors with the largest inner products, best first, for every vector for which ``queries`` is true (all without it)."""
    v = of(vectors, embedding).cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = vectors.select(of(vectors, vec_id).alias("id"), F.when(~bad, v).alias("v"), asks.alias("asks")).where("id IS NOT NULL AND size(v) > 0")
    kind, names = vectors.schema[vec_id].dataType, None
    if isinstance(kind, T.IntegralType):
        rows = rows.withColumn("id", F.col("id").cast("long"))
    else:
        names = numbered(rows.select("id").distinct())
        rows = rows.join(names, "id").select(F.col("n").alias("id"), "v", "asks")
    placed, widths = _placed(rows, block)
    made = cut(placed.groupBy("block").applyInArrow(_block(widths), _BLOCKED))
    asked = cut(placed.where("asks").groupBy("qblock").applyInArrow(_queries(widths), "q long, q_width int, q_ids binary, q_vectors binary"))

    def answers(pairs: DataFrame, floors: DataFrame) -> DataFrame:
        """The search of pairs (q, block); TOGETHER neighbouring blocks meet a query block at once."""
        near = F.expr(f"block div {TOGETHER}")
        wanted = pairs.groupBy("q", near.alias("near")).agg(F.collect_set("block").alias("wanted"))
        left = wanted.join(floors, "q").select("near", "wanted", "q", "q_width", "q_ids", "q_vectors", "floor")
        both = left.join(made.withColumn("near", near), "near").where(F.array_contains("wanted", F.col("block")))
        return both.select("q", "q_width", "q_ids", "q_vectors", "floor", "width", "ids", "vectors", "first", "high", "low", "norm").mapInArrow(_searched(k), _FOUND)

    none = asked.withColumn("floor", F.lit(None).cast("binary"))
    ranked = block_pairs(none, made, SEEDS).groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("best", "block")), asc=False), 1, SEEDS).alias("s"))
    first = cut(ranked.select("q", F.explode("s").alias("s")).select("q", F.col("s.block").alias("block")))
    early = cut(answers(first, none))
    floors = cut(asked.join(early.join(asked.select("q", "q_ids"), "q").groupBy("q").applyInArrow(_floors(k), "q long, floor binary"), "q", "left"))
    floors = floors.withColumn("floor", F.coalesce("floor", F.unhex(F.repeat(F.lit("000000000000F0FF"), (F.octet_length("q_ids") / 8).cast("int")))))  # -inf for all
    later = block_pairs(floors, made, None).join(first, ["q", "block"], "left_anti")
    part = early.unionByName(answers(later, floors))
    # the best of what the tasks found for each query
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("neighbour_id").alias("n")))), 1, k)
    merged = part.groupBy("q", "row", "vec_id").agg(best.alias("b")).select("vec_id", F.posexplode("b").alias("p", "b"))
    found = merged.select("vec_id", (F.col("p") + 1).alias("rank"), F.col("b.n").alias("neighbour_id"), (-F.col("b.s")).alias("score"))
    if names is None:
        return found.select(F.col("vec_id").cast(kind).alias("vec_id"), "rank", F.col("neighbour_id").cast(kind).alias("neighbour_id"), "score")
    one, two = names.toDF("a", "vec_id"), names.toDF("b", "neighbour_id")
    return found.join(one, "vec_id").join(two, "neighbour_id").select(F.col("a").alias("vec_id"), "rank", F.col("b").alias("neighbour_id"), "score")
