"""Arrow text batches to word arrays, without a Python object for each word.

A batch is handled in slices of about SLICE bytes, each a flat byte buffer in which
a word is a maximal run of ASCII letters, digits and non-ASCII bytes other than
punctuation. Texts are lower-cased first. Texts are never cut: one that is longer
than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
#: Texts of a slice at most, however short.
ROWS = 4096
_U = np.uint64
_WORD = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD[_lo : _hi + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


@dataclass
class Words:
    """data: normalised bytes (every non-word byte is a space); word i is data[start[i]:end[i]] and belongs to doc[i]; the words of document d are ptr[d]:ptr[d+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    ptr: np.ndarray
    raw: np.ndarray
    bounds: np.ndarray

    def contributions(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word byte's share of its word's polynomial hash, and where each word begins in them."""
        lens = self.end - self.start
        first = np.concatenate(([0], np.cumsum(lens)))
        at = np.arange(first[-1]) - np.repeat(first[:-1], lens)
        powers = _POWERS if not len(lens) or lens.max() <= len(_POWERS) else _powers(int(lens.max()))
        return (self.data[at + np.repeat(self.start, lens)].astype(np.uint64) + _U(1)) * powers[at], first

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        share, first = self.contributions()
        return mix(np.add.reduceat(share, first[:-1]))


def _clean(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, "")
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        raw = texts.cast(pa.large_binary())
        return pa.array([b.as_py().decode("utf-8", "replace").lower() for b in raw], pa.large_string())


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, each followed by a newline, and the n + 1 bounds."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, offsets, data = joined.buffers()
    bounds = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def words(texts: pa.Array, original: bool = False) -> Words:
    """The words of an array of strings; nulls have none. With ``original``, raw has the bytes before lower-casing (its lengths may differ)."""
    data, bounds = _flat(_clean(texts))
    n = len(texts)
    word = _WORD[data]
    for lead in (0xC2, 0xE2, 0xE3):  # punctuation in the Latin-1, general and CJK blocks
        at = np.flatnonzero(data[:-1] == lead)
        if not len(at):
            continue
        nxt = data[at + 1]
        if lead == 0xC2:
            at = at[(nxt < 0xC0) & ~np.isin(nxt, (0xAA, 0xB5, 0xBA))]
            word[at] = word[at + 1] = False
        else:
            at = at[(nxt == 0x80) | ((lead == 0xE2) & (nxt == 0x81))]
            word[at] = word[at + 1] = word[np.minimum(at + 2, len(data) - 1)] = False
    norm = np.where(word, data, np.uint8(32))
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    doc = np.searchsorted(bounds[1:], start, side="right")
    ptr = np.searchsorted(doc, np.arange(n + 1))
    raw = _flat(pc.fill_null(texts, ""))[0] if original else data
    return Words(norm, start, end, doc, ptr, raw, bounds)


def slices_of(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) for runs of texts that have about ``size`` bytes together."""
    if not len(texts):
        return
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64))
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(total, before + size, side="right"))), at + ROWS)
        yield at, texts.slice(at, to - at)
        at = to


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``size`` bytes together."""
    for at, part in slices_of(batch.column(column), size):
        yield batch.slice(at, len(part))
