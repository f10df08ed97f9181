"""Quality by nearest-neighbour voting in a latent semantic space.

A text is its byte trigrams (case and punctuation kept, digits as one), hashed to 2^12
cells with the value log(1 + count), scaled to length 1; beside them stands how much the
text repeats itself, log(distinct cells) / log(trigrams), spread over a few soft bins.
The labelled rows' vectors, scaled by inverse row frequency, are factorised by a
randomised singular value decomposition; the leading DIMENSIONS right factors project
every text into the latent space.

The labelled rows' latent vectors (at most 2 * LABELLED_PER_CLASS, whatever the input
holds) go to every task. Each text's cosines with all of them are computed exactly, one
block of texts at a time, and the NEIGHBOURS nearest vote with their cosines:

    quality = sum of cosine * label / sum of cosine   over the neighbours with a positive one.

A labelled row never votes for itself.

The only sample is the bounded set of labelled rows (those with the smallest hash of
their id), whole texts; every text is voted on whole.

Defined results
    * null texts and texts of fewer than three bytes: no trigram; quality null, keep false.
    * null or other labels, labels of absent ids: not used.
    * no labelled rows: quality null, keep false.
    * no neighbour with a positive cosine: quality null, keep false.
    * ties: cosines are compared at 5 digits; of equal ones the smaller labelled id votes.
    * repeated rows: the same result for each; repeated labels vote once each, an id with
      several labels or texts with the first in their order.
    * ids of any type; those of the labels are compared as strings if they have another one.
    * empty table: an empty result.
    * extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .frames import bounded, comparable, id_field, of, sized, small_batches, typed
from .words import _flat, slices

LABELLED_PER_CLASS = 1500
CELL_BITS = 12
DIMENSIONS = 128
NEIGHBOURS = 9
THRESHOLD = 0.5
DIGITS = 5
#: Texts in a dense block of counts.
BLOCK = 512
#: Centres of the bins for repetition, their width, and their weight against the trigrams.
BINS = np.arange(0.35, 1.01, 0.05, dtype=np.float32)
WIDTH, REPETITION = 0.04, 0.5
FEATURES = (1 << CELL_BITS) + len(BINS)
_BYTE = np.arange(256, dtype=np.uint32)
_BYTE[0x30:0x3A] = 0x30


def counts(texts: pa.Array) -> np.ndarray:
    """Texts x features, 0 for a text without a trigram."""
    raw, bounds = _flat(pc.fill_null(texts, ""))
    n, cells = len(texts), 1 << CELL_BITS
    if len(raw) < 3:
        return np.zeros((n, FEATURES), np.float32)
    b = _BYTE[raw]
    key = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)
    doc = np.repeat(np.arange(n), np.diff(bounds))[:-2]
    inside = np.ones(len(key), bool)  # a trigram ends before its text's newline
    for back in (1, 2, 3):
        at = bounds[1:] - back
        inside[at[(at >= 0) & (at < len(key))]] = False
    flat = np.bincount((doc * cells + key)[inside], minlength=n * cells)
    flat = flat.astype(np.float32).reshape(n, cells)
    total, distinct = flat.sum(1), (flat > 0).sum(1)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :cells] = _unit(np.log1p(flat))
    share = np.log(np.maximum(distinct, 1)) / np.log(np.maximum(total, 2))
    near = np.exp(-0.5 * ((share[:, None] - BINS) / WIDTH) ** 2)
    out[:, cells:] = np.where(total[:, None] > 0, REPETITION * near, 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass
class Model:
    #: the labelled rows' ids in ascending order
    ids: pa.Array
    labels: np.ndarray
    vectors: np.ndarray
    projection: np.ndarray

    def embed(self, texts: pa.Array) -> np.ndarray:
        return _unit(counts(texts) @ self.projection)

    def vote(self, ids: pa.Array, x: np.ndarray, neighbours: int) -> np.ndarray:
        """The quality of each row of x, NaN where nobody votes. ids: the rows' ids, of the same type as the labelled ones."""
        if not len(self.ids):
            return np.full(len(x), np.nan)
        m = len(self.ids)
        cosine = x @ self.vectors.T
        own = pc.index_in(ids, value_set=self.ids)
        mine = np.flatnonzero(pc.is_valid(own).to_numpy(zero_copy_only=False))
        cosine[mine, own.drop_null().to_numpy()] = -1
        # one whole number that orders by cosine, then by labelled id (self.ids ascend)
        order = np.rint(cosine * 10.0**DIGITS).astype(np.int64) * m + np.arange(m - 1, -1, -1)
        k = min(neighbours, m)
        near = np.argpartition(order, m - k, axis=1)[:, m - k :]
        near.sort(axis=1)
        weight = np.maximum(np.rint(np.take_along_axis(cosine, near, 1).astype(np.float64) * 10.0**DIGITS), 0)
        total = weight.sum(1)
        return np.divide((weight * self.labels[near]).sum(1), total, out=np.full(len(x), np.nan), where=total > 0)


def fit(rows: list[tuple[object, int, str]], dimensions: int = DIMENSIONS, kind: pa.DataType | None = None) -> Model:
    """A model of (id, label 0 or 1, text) rows; an id that has several labels or texts counts with the first in their order. kind: the Arrow type of ids."""
    first: dict[object, tuple[object, int, str]] = {}
    for r in sorted(r for r in rows if r[2]):
        first.setdefault(r[0], r)
    rows = list(first.values())
    ids, labels = pa.array([r[0] for r in rows], kind or (None if rows else pa.int64())), np.array([r[1] for r in rows], np.float64)
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.string())], names=["t"])
    parts = [counts(p.column(0).slice(at, BLOCK)) for p in slices(batch, 0) for at in range(0, p.num_rows, BLOCK)]
    x = np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)
    if not len(x):
        return Model(ids, labels, np.zeros((0, dimensions), np.float32), np.zeros((FEATURES, dimensions), np.float32))
    scale = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    scale[1 << CELL_BITS :] = 1
    x = x * scale
    # randomised SVD: a few power iterations on a random start, then the small problem
    k = min(dimensions, len(x))
    q = np.random.default_rng(7).standard_normal((x.shape[1], k + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    projection = np.ascontiguousarray(scale[:, None] * (q @ v[:k].T)).astype(np.float32)
    model = Model(ids, labels, np.zeros((0, k), np.float32), projection)
    model.vectors = np.concatenate([model.embed(p.column(0).slice(at, BLOCK)) for p in slices(batch, 0) for at in range(0, p.num_rows, BLOCK)])
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = LABELLED_PER_CLASS) -> Model:
    """Fit a model on at most ``per_class`` rows of each label; labels has ``doc_id`` and the label."""
    marked = labels.select(of(labels, doc_id).alias("_id"), of(labels, label).cast("int").alias("_key")).where("_id is not null and _key in (0, 1)")
    # at most 2 * per_class ids, chosen before any text is read
    chosen = sized(bounded(marked, per_class))
    same = comparable(of(docs, doc_id), F.col("_id"), docs.schema[doc_id].dataType, chosen.schema["_id"].dataType)
    rows = docs.join(chosen, same).select(of(docs, doc_id).alias("_own"), "_key", of(docs, text).alias("_text")).where("_text is not null")
    return fit([(r[0], r[1], r[2]) for r in rows.distinct().collect()], kind=to_arrow_type(docs.schema[doc_id].dataType))


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, quality, keep) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for slab in slices(whole, 1):
                for at in range(0, slab.num_rows, BLOCK):
                    part = slab.slice(at, BLOCK)
                    x = model.embed(part.column(1))
                    vote = np.where((x != 0).any(1), model.vote(part.column(0), x, neighbours), np.nan)
                    quality = np.round(vote, 6)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(quality, from_pandas=True), pa.array(quality >= threshold)], names=["doc_id", "quality", "keep"])

    return small_batches(docs).select(of(docs, doc_id).alias("doc_id"), of(docs, text).alias("text")).mapInArrow(run, typed(id_field(docs, doc_id, "doc_id"), "quality double, keep boolean"))
