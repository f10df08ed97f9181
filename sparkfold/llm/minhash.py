"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find groups.

Signature. A text is the set of its runs of SHINGLE lower-cased words (the whole
text, if it is shorter). Each element draws, for step j = 0, 1, ..., a rank
``j + r`` and a slot from its own random permutation of the slots; a slot keeps the
smallest rank. Because ranks grow with j, a text is finished as soon as its largest
slot is below the next step: long texts stop after one or two steps, and the
permutations make the estimate's variance lower than independent hashing does.

Candidates. Texts with equal signatures are joined at once and represented by one of
them. The others are candidates when ROWS consecutive slots agree (BANDS bands).

Verification. A pair is an edge if the share of equal slots is at least THRESHOLD.
Slots are compared by one byte each; the chance agreement of 1/256 is taken out.

Which pairs are verified. Groups only need connectivity, so pairs that are already
in one group are skipped, exactly:

1. every text against the smallest id it shares a band with;
2. every member of a bucket against its bucket's smallest id;
3. what is left are buckets that hold several groups. Two signatures that agree in
   half of their slots must agree in one of the PREFIX slots that are rarest among
   these texts, so only such pairs are formed, and only across groups: the groups at
   a slot value are numbered, and two members meet at the highest bit in which the
   numbers of their groups differ. Boilerplate that thousands of unlike texts share
   is not rare in any of them and pairs none of them; one large group isn't paired
   with itself. Nothing is capped.

The result is the set of connected components of the graph whose edges are all the
candidate pairs that pass verification.

No group is collected in one task: the smallest ids of copies and of buckets are
aggregates that are combined before the shuffle, and joins on them may be split.

Defined results
    * null, empty and wordless texts: no elements, never a near duplicate.
    * null id: takes no part; the row is kept, its group is null.
    * ids of any type that can be ordered; ids that aren't whole numbers are numbered
      in their order first.
    * repeated ids: one document with several texts; its groups are united and its
      rows stay or go together.
    * ties: the smallest id of a group stays.
    * empty table: an empty result of the same schema.
    * extra columns, whatever they are called, are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfold.operators.columnar import with_position
from sparkfold.operators.graph import components

from .frames import cut, id_field, of, sized, small_batches, typed, wrapped
from .words import mix, slices, words

SHINGLE = 3
SLOTS = 192
ROWS = 4
BANDS = SLOTS // ROWS
THRESHOLD = 0.5
#: Slots of which two signatures that pass must share one, if the rarest are taken: all but as many as may differ, and
#: 12 more, for slots that agree in the compared byte by chance (13 of them do so once in 10^16 pairs).
PREFIX = SLOTS - int(THRESHOLD * SLOTS) + 12
#: Elements whose permutations are held at once, but for a single text.
MOST = 1 << 17
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_STEP = _U(0x9E3779B97F4A7C15)
EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def superminhash(x: np.ndarray, ptr: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (documents x m, uint64: step and rank) of the element hashes x[ptr[d]:ptr[d+1]]; EMPTY where there are none."""
    n = len(ptr) - 1
    sig = np.full(n * m, EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(ptr))
    perm = None
    for j in range(m):
        if not len(x):
            break
        z = mix(x + _U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((z & _LOW) * _U(m - j)) >> _U(32)).astype(np.int64)
        rows = np.arange(len(x))
        slot = k if perm is None else perm[rows, k].astype(np.int64)
        np.minimum.at(sig, doc * m + slot, (_U(j) << _U(32)) | (z >> _U(32)))
        alive = (sig.reshape(n, m).max(1) >= (_U(j + 1) << _U(32)))[doc]
        if perm is None:  # only short texts come here, and their repeated elements leave
            x, doc = x[alive], doc[alive]
            order = np.lexsort((x, doc))
            x, doc = x[order], doc[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
            x, doc = x[new], doc[new]
            if len(x) > MOST:  # their permutations are made for a part of the texts at a time
                edge = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
                lo = 0
                while lo < len(edge) - 1:
                    hi = max(int(np.searchsorted(edge, edge[lo] + MOST, side="right")) - 1, lo + 1)
                    if hi - lo < len(edge) - 1:
                        sig.reshape(n, m)[doc[edge[lo:hi]]] = superminhash(x[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo], m)
                        lo = hi
                        continue
                    break
                else:
                    break
            k = (((mix(x + _STEP) & _LOW) * _U(m)) >> _U(32)).astype(np.int64)
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
            perm[:, 0] = k
            perm[np.arange(len(x)), k] = 0
        else:
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
            if alive.mean() < 0.9:
                x, doc, perm = x[alive], doc[alive], perm[alive]
    return sig.reshape(n, m)


def shingles(batch_text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of each text, and where each text's begin."""
    w = words(batch_text)
    h = w.hashes()
    count = np.diff(w.ptr)
    last = w.ptr[1:][w.doc] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)  # words from here to the text's end
    out = h.copy()
    for i in range(1, size):
        inside = np.flatnonzero(last > i)
        out[inside] = mix(out[inside] * _U(31) + h[inside + i])
    keep = (last >= size) | ((count < size)[w.doc] & (last == count[w.doc])) if len(h) else np.zeros(0, bool)
    return out[keep], np.concatenate(([0], np.cumsum(np.bincount(w.doc[keep], minlength=len(batch_text)))))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            x, ptr = shingles(batch.column(1))
            some = np.flatnonzero(np.diff(ptr) > 0)
            sig = superminhash(x, ptr)[some]
            fold = mix(sig + _U(1))
            band = np.zeros((len(some), BANDS), np.uint64)
            whole_key = np.zeros((len(some), 2), np.uint64)
            for i in range(ROWS):
                band = mix(band * _U(0x100000001B3) + fold[:, i::ROWS] + _U(i + 1))
            band = mix(band + np.arange(BANDS, dtype=np.uint64) * _STEP)
            for i in range(SLOTS):
                whole_key = mix(whole_key * _U(0x100000001B3) + fold[:, i : i + 1] + np.array([[3, 5]], np.uint64))
            short, more = (fold >> _U(56)).astype(np.uint8), (fold >> _U(40)).astype(np.uint16)
            size = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)),
                    pa.array(whole_key[:, 0].view(np.int64) if size else [], pa.int64()),
                    pa.array(np.ascontiguousarray(whole_key[:, 1]).view(np.int64) if size else [], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * BANDS, pa.int32()), pa.array(band.reshape(-1).view(np.int64), pa.int64())),
                    pa.array([r.tobytes() for r in short], pa.binary()),
                    pa.array([r.tobytes() for r in more], pa.binary()),
                ],
                names=["id", "k0", "k1", "bands", "slots", "more"],
            )
            del x, ptr, sig, fold, band, short, more
        pa.default_memory_pool().release_unused()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, r, tokens): each slot and three bytes of its value as one number."""
    at = np.arange(SLOTS, dtype=np.int64) << 24
    for batch in batches:
        n = batch.num_rows
        slots = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, SLOTS)
        more = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(n, SLOTS)
        flat = (at + (slots.astype(np.int64) << 16) + more).reshape(-1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * SLOTS, pa.int32()), pa.array(flat))], names=["id", "r", "tokens"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, sa, sb) that share a band."""
    for batch in batches:
        sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS) for i in (2, 3)]
        yield batch.take(pa.array(np.flatnonzero((sides[0] == sides[1]).all(2).any(1))))


def _agreeing(batches: Iterator[pa.RecordBatch], least: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3)]
        same = (sides[0] == sides[1]).mean(1)
        same = (same - 1 / 256) / (1 - 1 / 256)
        ok = np.flatnonzero(same >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], names=["a", "b"])


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k0, k1, bands, slots, more) of every row with an id and at least one word."""
    rows = small_batches(docs).select(of(docs, doc_id).alias("id"), of(docs, text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_signed, typed(id_field(docs, doc_id, "id"), "k0 long, k1 long, bands array<long>, slots binary, more binary"))


def verified(pairs: DataFrame, slots: DataFrame, banded: bool = False) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough; with ``banded``, if they share a band too."""
    one = pairs.join(slots.select(F.col("id").alias("a"), F.col("slots").alias("sa")), "a")
    two = one.join(slots.select(F.col("id").alias("b"), F.col("slots").alias("sb")), "b").select("a", "b", "sa", "sb")
    if banded:
        two = two.mapInArrow(_banded, two.schema)
    return two.mapInArrow(_agreeing, "a long, b long")


def across(left: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (id, r, slots, more) in different groups r that share one of their PREFIX rarest slot values; no pair that agrees in half of the slots is missing."""
    tokens = cut(left.select("id", "r", "slots", "more").mapInArrow(_tokens, "id long, r long, tokens array<long>")).select("id", "r", F.explode("tokens").alias("token"))
    counts = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).where("n > 1"))
    shared = tokens.join(counts, "token")
    # slot values of their own come first in the order of rarity and pair nothing; 192 rows a window at most
    mine = Window.partitionBy("id")
    ranked = shared.withColumn("_rank", F.row_number().over(mine.orderBy("n", "token"))).withColumn("_all", F.count(F.lit(1)).over(mine))
    some = cut(ranked.where(F.col("_rank") <= PREFIX - SLOTS + F.col("_all")).where("lo <> hi").select("id", "r", "token"))
    # the groups at a slot value, numbered; a pair of groups meets at the highest bit in which its numbers differ
    groups = some.select("token", "r").distinct()
    place = groups.withColumn("g", (F.row_number().over(Window.partitionBy("token").orderBy("r")) - 1).cast("long"))
    places = cut(place.join(groups.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "token"))
    bits = F.sequence(F.lit(0), F.ceil(F.log2("_n")).cast("int") - 1)
    at = some.join(places, ["token", "r"]).select("id", "token", "g", F.explode(bits).alias("bit"))
    at = at.select("id", "token", "bit", F.call_function("shiftright", "g", F.col("bit") + 1).alias("above"), F.call_function("shiftright", "g", "bit").bitwiseAND(F.lit(1).cast("long")).alias("side"))
    one, two = (at.where(F.col("side") == s).drop("side").withColumnRenamed("id", x) for s, x in ((0, "x"), (1, "y")))
    return one.join(two, ["token", "bit", "above"]).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _nodes(signed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(signed with whole numbers as ids, (id, node) or None): each distinct pair of id and signature is a node if ids aren't whole numbers, or one has several signatures."""
    whole = isinstance(signed.schema["id"].dataType, T.IntegralType)
    if whole and signed.groupBy("id").agg(F.min("k0").alias("a"), F.max("k0").alias("b"), F.min("k1").alias("c"), F.max("k1").alias("d")).where("a <> b OR c <> d").isEmpty():
        return signed.withColumn("id", F.col("id").cast("long")), None
    keys = signed.select("id", "k0", "k1").distinct().withColumn("_by", F.struct("id", "k0", "k1"))
    keys = cut(with_position(keys, "_by", "node").select("id", "k0", "k1", "node"))
    placed = signed.join(keys, ["id", "k0", "k1"]).drop("id").withColumnRenamed("node", "id")
    return cut(placed), keys.select("id", "node")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, root) for every id that is a near duplicate of a smaller one; root is its group's smallest id."""
    signed, names = _nodes(cut(signatures(docs, doc_id, text)))
    roots = _linked(signed, names)
    kind = docs.schema[doc_id].dataType
    if names is None:
        return roots.select(F.col("node").cast(kind).alias("id"), F.col("root").cast(kind).alias("root"))
    first = names.select(F.col("node").alias("root"), F.col("id").alias("_first"))
    return cut(roots.join(names, "node").join(first, "root").where("id <> _first").select("id", F.col("_first").alias("root")).distinct())


def _linked(signed: DataFrame, names: DataFrame | None) -> DataFrame:
    """(node, root) of signed rows whose ids are whole numbers; nodes with one name are united."""
    copies = signed.groupBy("k0", "k1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = signed.join(sized(cut(copies.drop("_n"))), ["k0", "k1"], "left")
    equal = marked.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    if names is not None:
        own = names.join(names.groupBy("id").agg(F.min("node").alias("b")), "id").where("node <> b")
        equal = equal.unionByName(own.select(F.col("node").alias("a"), "b"))
    equal = cut(equal)
    # one row of each signature; of copies the rank limit leaves one a partition before the shuffle
    one = marked.where("id = first").withColumn("_r", F.row_number().over(Window.partitionBy("k0", "k1").orderBy("id"))).where("_r = 1")
    alone = marked.where("first IS NULL").select("id", "bands", "slots", "more").unionByName(one.select("id", "bands", "slots", "more"))
    slots = alone.select("id", "slots")
    keyed = alone.select("id", F.explode("bands").alias("key"))
    hubs = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("_top")).where("hub <> _top").drop("_top"))
    placed = cut(keyed.join(hubs, "key"))

    # each text against the smallest id that it shares a bucket with
    first = placed.where("id <> hub").groupBy(F.col("id").alias("a")).agg(F.min("hub").alias("b"))
    edges = cut(verified(first, slots))
    roots = components(edges)

    def as_edges(found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias("a"), F.col("root").alias("b"))

    def labelled(rows: DataFrame, column: str, label: str) -> DataFrame:
        found = roots.select(F.col("node").alias(column), F.col("root").alias(label))
        return rows.join(found, column, "left").withColumn(label, F.coalesce(label, column))

    # each bucket against its smallest id
    star = labelled(labelled(placed.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "a", "ra"), "b", "rb")
    star = star.where("ra <> rb").select("a", "b").join(first, ["a", "b"], "left_anti")
    more = cut(verified(star, slots))
    if not more.isEmpty():  # what is joined so far is a forest of stars, far smaller than its edges
        roots = components(as_edges(roots).unionByName(more))

    # whatever is left: pairs of one bucket in different groups
    own = labelled(placed.select("id", "key"), "id", "r")
    split = cut(own.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("key"))
    if not split.isEmpty():
        left = cut(own.join(sized(split), "key", "left_semi").select("id", "r").distinct())
        rest = cut(verified(across(left.join(alone.select("id", "slots", "more"), "id")), slots, banded=True))
        equal = equal.unionByName(rest)
    if equal.isEmpty():
        return roots
    return components(as_edges(roots).unionByName(equal))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id, keep) for every row: the smallest id of its group of near duplicates, and whether it is that one."""
    roots = grouped(docs, doc_id, text)
    ids = docs.select(of(docs, doc_id).alias("doc_id"))
    found = ids.join(sized(roots), F.col("doc_id") == F.col("id"), "left")
    return found.select("doc_id", F.coalesce("root", F.col("doc_id")).alias("group_id"), F.col("root").isNull().alias("keep"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates, all columns unchanged."""
    drop = sized(grouped(docs, doc_id, text).select("id"))
    rows = wrapped(docs, _id=of(docs, doc_id))
    return rows.join(drop, F.col("_id") == F.col("id"), "left_anti").select("_row.*")
