"""Toxicity by a counterfactually regularised linear classifier.

Features of a text are the words in it and the beginnings of its words (4 to 7 bytes;
they reach unseen inflections), hashed to 2^18 cells; a cell that occurs in the text is
one feature, and one that occurs twice or more another. Fitting:

1. Screening. A feature stays if its share of toxic training rows differs from that of
   the others by more than SCREEN standard errors and it occurs in LEAST of them; those
   of identity terms always stay.
2. Counterfactuals. Each labelled text that names a group is rewritten with every
   identity term swapped for another of its category.
3. Proximal gradient descent on

       class-balanced logistic loss + SWAP / 2 * mean (score(text) - score(rewritten))^2 + L1 |w|.

   The middle term takes the weight off identity terms that toxic training rows happen
   to mention, so that neutral mentions aren't flagged; the last one leaves few cells,
   so that long clean texts don't add up small weights.

The classifier is fitted on at most TRAIN_PER_CLASS rows of each label (those with the
smallest hash of their id), whole texts; every text is scored whole.

Defined results
    * null, empty and wordless texts: no features; the score of the intercept alone.
    * null or other labels, labels of absent ids: not used in training.
    * only one class in training: nothing is learned; every score is 0.5 and nothing toxic.
    * repeated rows: the same result for each; repeated labels count once each.
    * ids of any type; those of the labels are compared as strings if they have another one.
    * empty table: an empty result.
    * extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded, comparable, id_field, of, sized, small_batches, typed
from .words import Words, mix, slices, words

TRAIN_PER_CLASS = 3000
BITS = 18
PREFIXES = (4, 5, 6, 7)
SCREEN = 4.0
LEAST = 5
SWAP = 4.0
L1 = 2e-3
RELAX = 20
STEPS = 400
THRESHOLD = 0.5
#: Terms that are swapped for one another, by category and language.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "hindus"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_NEXT: dict[str, tuple[str, ...]] = {}
for _group in IDENTITIES:
    for _term in _group:
        _NEXT.setdefault(_term, _group)
_PATTERN = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")\b", re.IGNORECASE)
_U = np.uint64


def swapped(text: str, shift: int = 1) -> str:
    """The text with every identity term replaced by the one ``shift`` places on in its category."""

    def other(m: re.Match) -> str:
        group = _NEXT[m[0].lower()]
        return group[(group.index(m[0].lower()) + shift) % len(group)]

    return _PATTERN.sub(other, text)


def cells(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of every word and of every beginning of one, repeats included."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    share, first = w.contributions()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(share)))  # wraps; differences are right
    lens = w.end - w.start
    docs, found = [w.doc], [mix(sums[first[1:]] - sums[first[:-1]])]
    for p in PREFIXES:
        at = np.flatnonzero(lens > p)
        docs.append(w.doc[at])
        found.append(mix((sums[first[:-1][at] + p] - sums[first[:-1][at]]) ^ _U(0x5851F42D4C957F2D * p & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(docs).astype(np.int64), (np.concatenate(found) >> _U(64 - BITS)).astype(np.int64)


def features(doc: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: the cell, and 2^BITS more than it if it occurs again."""
    key, times = np.unique(doc << BITS | cell, return_counts=True)
    doc, cell = key >> BITS, key & ((1 << BITS) - 1)
    again = np.flatnonzero(times > 1)
    return np.concatenate((doc, doc[again])), np.concatenate((cell, cell[again] + (1 << BITS)))


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The (text, feature) pairs of a list of texts."""
    found, base = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    for part in slices(batch, 0):
        d, f = features(*cells(words(part.column(0))))
        found.append((d + base, f))
        base += part.num_rows
    return np.concatenate([d for d, _ in found]), np.concatenate([f for _, f in found])


@dataclass
class Model:
    #: weight of each feature, and the intercept
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of toxicity of each text."""
        d, c = cells(words(texts))
        used = (self.weights[: 1 << BITS] != 0) | (self.weights[1 << BITS :] != 0)
        some = np.flatnonzero(used[c])  # few cells have a weight, so few pairs are left to make distinct
        d, f = features(d[some], c[some])
        total = np.bincount(d, self.weights[f], minlength=len(texts))
        return 1 / (1 + np.exp(-(total + self.intercept)))


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, changed: np.ndarray, lift: np.float32, l1: float, steps: int) -> np.ndarray:
    """Weights and intercept by accelerated proximal gradient descent."""
    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(20):  # the largest eigenvalue of the quadratic bound, by power iteration
        g = weight * (x @ v[:-1] + v[-1])
        u = np.append(x.T @ g / 4 + lift * (changed.T @ (changed @ v[:-1])), g.sum() / 4)
        size = float(np.linalg.norm(u))
        v = (u / size).astype(np.float32)
    rate = 1 / (1.1 * size)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-(x @ ahead[:-1] + ahead[-1]))) - y)
        grad = np.append(x.T @ g + lift * (changed.T @ (changed @ ahead[:-1])), g.sum()).astype(np.float32)
        new = ahead - np.float32(rate) * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * l1, 0)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + np.float32((momentum - 1) / after) * (new - w)
        w, momentum = new, after
    return w


def fit(rows: list[tuple[int, str]], swap: float = SWAP, l1: float = L1, steps: int = STEPS) -> Model:
    """A model of (label 0 or 1, text) rows."""
    y = np.array([r[0] for r in rows], np.float32)
    texts = [r[1] or "" for r in rows]
    model = Model(np.zeros(2 << BITS), 0.0)
    if not len(y) or y.min() == y.max():
        return model
    doc, feature = presence(texts)
    pos = np.bincount(feature[y[doc] == 1], minlength=2 << BITS)
    neg = np.bincount(feature[y[doc] == 0], minlength=2 << BITS)
    n1, n0 = float(y.sum()), float((1 - y).sum())
    rate = (pos + neg) / len(y)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    keep = (np.abs(pos / n1 - neg / n0) > SCREEN * error) & (pos + neg >= LEAST)
    named_by = np.unique(presence(sorted(_NEXT))[1])
    keep[named_by] = keep[named_by + (1 << BITS)] = True
    used = np.flatnonzero(keep & (pos + neg > 0))
    if not len(used):
        return model

    def matrix(doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(used, feature)
        ok = used[np.minimum(at, len(used) - 1)] == feature
        out = np.zeros((n, len(used)), np.float32)
        out[doc[ok], at[ok]] = 1
        return out

    x = matrix(doc, feature, len(texts))
    named = [i for i in np.unique(doc[np.isin(feature, named_by)]).tolist() if _PATTERN.search(texts[i])]
    pairs = [(i, s) for i in named for s in (1, 2)]
    changed = x[[i for i, _ in pairs]] - matrix(*presence([swapped(texts[i], s) for i, s in pairs]), len(pairs)) if pairs else np.zeros((0, len(used)), np.float32)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    lift = np.float32(swap / max(len(pairs), 1))
    w = _descend(x, y, weight, changed, lift, l1, steps)
    left = np.flatnonzero(w[:-1])
    if not len(left):
        return Model(model.weights, float(w[-1]))
    w = _descend(np.ascontiguousarray(x[:, left]), y, weight, np.ascontiguousarray(changed[:, left]), lift, l1 / RELAX, steps)
    model.weights[used[left]] = w[:-1]
    return Model(model.weights, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Model:
    """Fit a model on at most ``per_class`` rows of each label; labels has ``doc_id`` and the label."""
    marked = labels.select(of(labels, doc_id).alias("_id"), of(labels, label).cast("int").alias("_key")).where("_id is not null and _key in (0, 1)")
    # at most 2 * per_class ids, chosen before any text is read
    chosen = sized(bounded(marked, per_class))
    same = comparable(of(docs, doc_id), F.col("_id"), docs.schema[doc_id].dataType, chosen.schema["_id"].dataType)
    rows = docs.join(chosen, same).select("_id", "_key", of(docs, text).alias("_text")).where("_text is not null")
    return fit(sorted((r[0], r[1]) for r in rows.distinct().select("_key", "_text").collect()))


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                score = np.round(model.scores(part.column(1)), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(score > threshold)], names=["doc_id", "score", "toxic"])

    return small_batches(docs).select(of(docs, doc_id).alias("doc_id"), of(docs, text).alias("text")).mapInArrow(run, typed(id_field(docs, doc_id, "doc_id"), "score double, toxic boolean"))
