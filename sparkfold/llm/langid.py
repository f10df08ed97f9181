"""Language identification of spans: script candidates, per-word scores, Viterbi.

1. Script. The first letter of a word other than ASCII digits gives its script, by
   ranges of code points. A script that only one known language uses decides the word;
   otherwise the candidates are the languages that the training rows use that script
   for. Of a script that no training row uses, the languages of ALONE are candidates:
   the first one unless letters that another one of them has alone (MARKS) say otherwise,
   so Han without kana is Chinese and Cyrillic with the letter yi Ukrainian.
2. Score. A word's score for a candidate is the sum over its bytes of
   log P(byte trigram | language), with the word's edges as spaces. Trigrams are
   hashed to 2^16 cells; the model is a table of cells x languages.
3. Viterbi. Words of a text form a chain; staying in a language is free, switching
   costs PENALTY. The best path labels every word, and runs of one label are spans.
   All texts of a group advance together, one word position at a time.
4. Rejection. A text stays if KNOWN_SHARE of its words, numbers and symbols aside, are
   explained by the language of their span, whichever it is. A word that scores no
   better than cells never seen in its language isn't explained. Words in letters for
   which no language is known are UNKNOWN: nothing speaks against them, so they count
   as explained, and a text that consists of them stays, labelled UNKNOWN.

The model is fitted on at most TRAIN_PER_LANGUAGE rows of each value of the language
column (those with the smallest hash of their id), whole texts. That bound is the
only sample; every text is scored whole.

Defined results
    * null and empty texts, texts without words, of numbers or symbols only: lang null,
      no spans, keep false.
    * letters of no known script, or of a script without a known language: "und", kept.
    * null language label: not used in training; the row is labelled like others.
    * no usable training rows: scripts with languages in ALONE still decide; all other
      words are "und".
    * any number of languages.
    * ties: the language whose name sorts first; a tie between staying and switching
      stays.
    * repeated rows: the same result for each.
    * empty table: an empty result of the same schema.
    * ids of any type; extra columns, whatever they are called, are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded, id_field, of, sized, small_batches, typed, wrapped
from .words import Words, slices, slices_of, words

TRAIN_PER_LANGUAGE = 300
CELLS = 1 << 16
PENALTY = 18.0
#: Share of a text's words, numbers and symbols aside, that known languages must explain; with less the text is rejected.
KNOWN_SHARE = 0.5
GROUP_WORDS = 1 << 19
FLOOR = -1e4
#: The language of words in letters for which none is known.
UNKNOWN = "und"
#: script: its ranges of code points
RANGES = {
    "number": "30-39 660-669 6F0-6F9 966-96F FF10-FF19",
    "latin": "41-5A 61-7A AA BA C0-D6 D8-F6 F8-24F 250-2AF 1E00-1EFF 2C60-2C7F A720-A7FF FB00-FB06 FF21-FF3A FF41-FF5A",
    "greek": "370-3FF 1F00-1FFF",
    "cyrillic": "400-52F 1C80-1C8F 2DE0-2DFF A640-A69F",
    "armenian": "530-58F FB13-FB17",
    "hebrew": "590-5FF FB1D-FB4F",
    "arabic": "600-65F 66A-6EF 6FA-6FF 750-77F 8A0-8FF FB50-FDFF FE70-FEFC",
    "syriac": "700-74F",
    "thaana": "780-7BF",
    "devanagari": "900-965 970-97F A8E0-A8FF",
    "bengali": "980-9FF",
    "gurmukhi": "A00-A7F",
    "gujarati": "A80-AFF",
    "oriya": "B00-B7F",
    "tamil": "B80-BFF",
    "telugu": "C00-C7F",
    "kannada": "C80-CFF",
    "malayalam": "D00-D7F",
    "sinhala": "D80-DFF",
    "thai": "E00-E7F",
    "lao": "E80-EFF",
    "tibetan": "F00-FFF",
    "myanmar": "1000-109F AA60-AA7F",
    "georgian": "10A0-10FF 1C90-1CBF 2D00-2D2F",
    "ethiopic": "1200-139F 2D80-2DDF AB00-AB2F",
    "khmer": "1780-17FF 19E0-19FF",
    "mongolian": "1800-18AF",
    "hangul": "1100-11FF 3130-318F A960-A97F AC00-D7FF",
    "kana": "3040-30FF 31F0-31FF FF66-FF9F",
    "han": "2E80-2FDF 3005-3007 3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF",
    "symbol": "80-A9 AB-B9 BB-BF D7 F7 2B0-2FF 2000-2BFF 3000-3004 3008-3020 3200-33FF 4DC0-4DFF E000-F8FF FE00-FE0F FF00-FF0F FFE0-FFFF 1F000-1FAFF E0000-10FFFF",
}
#: ... and letters of any other
SCRIPTS = (*RANGES, "other")
#: Languages of scripts for which no training rows are needed, the likeliest first.
ALONE = {
    "greek": ("el",), "cyrillic": ("ru", "uk", "be", "sr", "mk", "kk"), "armenian": ("hy",), "hebrew": ("he",), "arabic": ("ar", "fa", "ur", "ps"), "syriac": ("syr",), "thaana": ("dv",),
    "devanagari": ("hi", "mr"), "bengali": ("bn", "as"), "gurmukhi": ("pa",), "gujarati": ("gu",), "oriya": ("or",), "tamil": ("ta",), "telugu": ("te",), "kannada": ("kn",), "malayalam": ("ml",),
    "sinhala": ("si",), "thai": ("th",), "lao": ("lo",), "tibetan": ("bo",), "myanmar": ("my",), "georgian": ("ka",), "ethiopic": ("am",), "khmer": ("km",), "mongolian": ("mn",), "hangul": ("ko",), "kana": ("ja",), "han": ("zh", "ja"),
}
#: Letters that only one language of its script's ALONE has.
MARKS = {"uk": "іїєґ", "be": "ў", "sr": "ђћ", "mk": "ѓќѕ", "kk": "қңғұ", "fa": "پچژگ", "ur": "ٹڈڑے", "ps": "ټډړښ", "mr": "ळ", "as": "ৰৱ"}
#: Scores of the likeliest language, and of a language whose letter a word has, in a script without training rows.
LIKELY, MARKED = 1e-3, 4.0
_INDEX = {s: i for i, s in enumerate(SCRIPTS)}


def _table() -> tuple[np.ndarray, np.ndarray]:
    """(first code points, scripts) of consecutive ranges."""
    spans = sorted((int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1, _INDEX[s]) for s, ranges in RANGES.items() for r in ranges.split())
    first, which, end = [0], [_INDEX["other"]], 0
    for lo, hi, s in spans:
        if lo > end:
            first.append(end)
            which.append(_INDEX["other"])
        first.append(lo)
        which.append(s)
        end = hi
    return np.array([*first, end]), np.array([*which, _INDEX["other"]], np.int8)


_FIRST, _SCRIPT = _table()
_ASCII = _SCRIPT[np.searchsorted(_FIRST, np.arange(256), side="right") - 1]
_LETTER = np.zeros(256, bool)
for _lo, _hi in ((0x41, 0x5A), (0x61, 0x7A), (0xC2, 0xFF)):
    _LETTER[_lo : _hi + 1] = True


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 characters that begin at these bytes."""
    b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    low = [x & 0x3F for x in b]
    two, three = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]
    four = (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    return np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))


def scripts(w: Words) -> np.ndarray:
    """Each word's script: kana if any character of it is, else that of its first letter; number if it has none."""
    data = w.data
    if not len(w.start):
        return np.zeros(0, np.int8)
    begin = w.start.copy()
    digit = np.flatnonzero((data[begin] >= 0x30) & (data[begin] <= 0x39))
    if len(digit):  # 3rd is a word, 2024 isn't
        letters = np.flatnonzero(_LETTER[data])
        nxt = np.append(letters, len(data))[np.searchsorted(letters, begin[digit])]
        inside = nxt < w.end[digit]
        begin[digit[inside]] = nxt[inside]
    out = _ASCII[data[begin]]
    wide = np.flatnonzero(data[begin] >= 0x80)
    out[wide] = _SCRIPT[np.searchsorted(_FIRST, code_points(data, begin[wide]), side="right") - 1]
    kana = (data[:-1] == 0xE3) & (data[1:] >= 0x81) & (data[1:] <= 0x83)
    if kana.any():
        seen = np.concatenate(([0], np.cumsum(kana), [0]))
        seen[-1] = seen[-2]
        out[seen[w.end] > seen[w.start]] = _INDEX["kana"]
    return out


_MARK_OF: dict[int, list[tuple[int, str]]] = {}  # leading byte: (second byte and further ones, language)
for _lang, _letters in MARKS.items():
    for _c in _letters:
        _bytes = _c.encode()
        _MARK_OF.setdefault(_bytes[0], []).append((int.from_bytes(_bytes[1:], "big"), _lang))


def marks(w: Words) -> dict[str, np.ndarray]:
    """language: the words that have a letter of its own."""
    data, found = w.data, {}
    if not len(w.start) or not (data >= 0xC2).any():
        return {}
    for lead, letters in _MARK_OF.items():
        at = np.flatnonzero(data == lead)
        if not len(at):
            continue
        tail = data[np.minimum(at + 1, len(data) - 1)].astype(np.int64)
        if lead >= 0xE0:
            tail = tail << 8 | data[np.minimum(at + 2, len(data) - 1)]
        for code, lang in letters:
            hit = at[tail == code]
            if len(hit):
                word = np.searchsorted(w.start, hit, side="right") - 1
                found.setdefault(lang, []).append(word)
    return {lang: np.unique(np.concatenate(x)) for lang, x in found.items()}


def cells(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The trigram cell at every word byte, and where each word's begin."""
    lens = w.end - w.start
    first = np.concatenate(([0], np.cumsum(lens)))
    at = np.arange(first[-1]) + np.repeat(w.start - first[:-1], lens)
    d = w.data.astype(np.uint32)
    before = np.where(at > 0, d[at - 1], np.uint32(32))
    key = (before << np.uint32(16)) | (d[at] << np.uint32(8)) | d[np.minimum(at + 1, len(d) - 1)]
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), first


@dataclass
class Model:
    languages: tuple[str, ...]
    #: log P(cell | language), cells x trained languages (the first ones of languages)
    table: np.ndarray
    #: scripts x languages: which are candidates
    allowed: np.ndarray

    @property
    def trained(self) -> int:
        return self.table.shape[1]


def fit(rows: list[tuple[str, str]], alpha: float = 0.05) -> Model:
    """A model of (language, text) rows."""
    trained = tuple(sorted({lang for lang, text in rows if lang and text}))
    extra = tuple(sorted({x for v in ALONE.values() for x in v} - set(trained)))
    languages = (*trained, *extra, *([UNKNOWN] if UNKNOWN not in trained else []))
    counts = np.zeros((len(trained), CELLS))
    uses = np.zeros((len(trained), len(SCRIPTS)))
    for i, lang in enumerate(trained):
        texts = [t for x, t in rows if x == lang and t]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
        for part in slices(batch, 0):
            w = words(part.column(0))
            if len(w.start):
                counts[i] += np.bincount(cells(w)[0], minlength=CELLS)
                uses[i] += np.bincount(scripts(w), minlength=len(SCRIPTS))
    table = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * CELLS)).T.astype(np.float32).reshape(CELLS, len(trained))
    allowed = np.zeros((len(SCRIPTS), len(languages)), bool)
    for i in range(len(trained)):
        letters = uses[i].copy()
        letters[[_INDEX["number"], _INDEX["symbol"]]] = 0
        allowed[:, i] = letters > 0.05 * max(letters.sum(), 1)
    for script, names in ALONE.items():
        if not allowed[_INDEX[script], : len(trained)].any():
            for name in names:
                allowed[_INDEX[script], languages.index(name)] = True
    for script in set(SCRIPTS) - {"number", "symbol"}:
        if not allowed[_INDEX[script]].any():
            allowed[_INDEX[script], languages.index(UNKNOWN)] = True
    return Model(languages, table, allowed)


def score(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Words x trained languages: log scores; each word's script; and which words have a letter of one language."""
    n = len(w.start)
    if not n:
        return np.zeros((0, model.trained), np.float32), np.zeros(0, np.int8), {}
    at, first = cells(w)
    found = np.add.reduceat(model.table[at], first[:-1], axis=0) if model.trained else np.zeros((n, 0), np.float32)
    return found, scripts(w), marks(w)


def choices(found: np.ndarray, script: np.ndarray, marked: dict[str, np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, languages, known): a column for each language that some script here allows; FLOOR where a word's script doesn't, 0 where it allows none (not known)."""
    present = np.flatnonzero(np.bincount(script, minlength=len(SCRIPTS)))
    columns = np.flatnonzero(model.allowed[present].any(0))
    if not len(columns):
        return np.zeros((len(script), 1), np.float32), np.zeros(1, np.int64), np.zeros(len(script), bool)
    allowed = model.allowed[:, columns]
    out = np.zeros((len(script), len(columns)), np.float32)
    trained = columns < model.trained
    out[:, trained] = found[:, columns[trained]]
    place = {model.languages[c]: i for i, c in enumerate(columns.tolist())}
    for s in present:
        words_of = np.flatnonzero(script == s)
        if not allowed[s].any():
            out[words_of] = 0
        elif not allowed[s].all():
            out[np.ix_(words_of, ~allowed[s])] = FLOOR
        names = ALONE.get(SCRIPTS[s], ())
        if len(names) > 1 and not model.allowed[s, : model.trained].any():
            out[words_of, place[names[0]]] += LIKELY
            for name in names:
                own = marked.get(name)
                if own is not None:
                    out[own[script[own] == s], place[name]] += MARKED
    return out, columns, allowed.any(1)[script]


def viterbi(scores: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; word t of text d is row ptr[d] + t. All texts advance together, longest first."""
    n = np.diff(ptr)
    order = np.argsort(-n, kind="stable")
    base, length = ptr[:-1][order], n[order]
    longest = int(length[0]) if len(length) else 0
    if not longest:
        return np.zeros(len(scores), np.int32)
    k = scores.shape[1]
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # texts longer than t
    # where a path comes from: the best state before, or the same one, of which each state has a bit
    back, stays = np.zeros(len(scores), np.int32), np.zeros((len(scores), -(-k // 8)), np.uint8)
    v = scores[base[: active[0]]].astype(np.float64)
    last = np.zeros((len(base), k))
    last[: active[0]] = v
    for t in range(1, longest):
        a = active[t]
        v = last[:a]
        best = v.argmax(1)
        top = v[np.arange(a), best] - penalty
        stay = v >= top[:, None]
        back[base[:a] + t], stays[base[:a] + t] = best, np.packbits(stay, axis=1)
        np.maximum(v, top[:, None], out=v)
        v += scores[base[:a] + t]
    state = np.zeros(len(base), np.int64)
    state[: active[0]] = last[: active[0]].argmax(1)
    path = np.zeros(len(scores), np.int32)
    for t in range(longest - 1, 0, -1):
        a = active[t]
        at = base[:a] + t
        s = state[:a]
        path[at] = s
        state[:a] = np.where(stays[at, s >> 3] >> (7 - (s & 7)) & 1, s, back[at])
    path[base[: active[0]]] = state[: active[0]]
    return path


def label(w_ptr: np.ndarray, found: np.ndarray, script: np.ndarray, marked: dict[str, np.ndarray], model: Model, penalty: float = PENALTY) -> tuple[list, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language or None, share, counted words) of each text, and its spans as (offsets, language index, first word, words)."""
    names, share, total, _, spans = judged(w_ptr, found, script, marked, np.ones(len(script), np.int64), model, penalty)
    return names, share, total, spans


def judged(w_ptr: np.ndarray, found: np.ndarray, script: np.ndarray, marked: dict[str, np.ndarray], size: np.ndarray, model: Model, penalty: float = PENALTY) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What label gives, and before the spans the share of words, numbers and symbols aside, that their language explains: some cell of them was seen in it, or their script alone decides. size: bytes of each word."""
    docs, k = len(w_ptr) - 1, len(model.languages)
    doc = np.repeat(np.arange(docs), np.diff(w_ptr))
    scores, columns, counted = choices(found, script, marked, model)
    best = viterbi(scores, w_ptr, penalty)
    path = columns[best]
    unseen = np.append(model.table.min(0), np.full(k - model.trained, -np.inf)) if k else np.zeros(1)
    explained = counted & (scores[np.arange(len(best)), best] > unseen[path] * size + 1.5)  # one seen cell adds log 21 or more
    known = np.bincount(doc[explained], minlength=docs) / np.maximum(np.bincount(doc[counted], minlength=docs), 1)
    tally = np.bincount(doc[counted] * k + path[counted], minlength=docs * k).reshape(docs, k) if k else np.zeros((docs, 1), np.int64)
    total = tally.sum(1)
    main = tally.argmax(1)
    share = tally[np.arange(docs), main] / np.maximum(total, 1)
    names = [model.languages[i] if t else None for i, t in zip(main.tolist(), total.tolist(), strict=True)]
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
    new &= total[doc] > 0
    at = np.flatnonzero(new)
    offsets = np.searchsorted(doc[at], np.arange(docs + 1))
    stop = np.append(at[1:], len(path))
    stop = np.minimum(stop, w_ptr[1:][doc[at]]) if len(at) else stop[:0]
    return names, share, total, known, (offsets, path[at], at - w_ptr[:-1][doc[at]], stop - at)


SPANS = "array<struct<lang:string,first_word:int,words:int>>"


def grouped(batches: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array], model: Model, penalty: float) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """Each input slice with its labels; texts are labelled about GROUP_WORDS words at a time."""
    parts, words_of, held = [], [], 0

    def flush() -> Iterator[tuple]:
        ptrs = [w[0] for w in words_of]
        base = np.concatenate(([0], np.cumsum([p[-1] for p in ptrs])))
        ptr = np.concatenate([[0], *[p[1:] + b for p, b in zip(ptrs, base, strict=False)]]).astype(np.int64)
        found, script, size = (np.concatenate([w[i] for w in words_of]) for i in (1, 2, 4))
        marked: dict[str, list[np.ndarray]] = {}
        for w, b in zip(words_of, base, strict=False):
            for lang, at in w[3].items():
                marked.setdefault(lang, []).append(at + b)
        names, share, total, known, (offsets, which, first, count) = judged(ptr, found, script, {k: np.concatenate(v) for k, v in marked.items()}, size, model, penalty)
        lo = 0
        for part in parts:
            hi = lo + part.num_rows
            spans = slice(offsets[lo], offsets[hi])
            yield part, names[lo:hi], share[lo:hi], total[lo:hi], known[lo:hi], (offsets[lo : hi + 1] - offsets[lo], which[spans], first[spans], count[spans])
            lo = hi

    for whole in batches:
        texts = text(whole)
        for at, part in slices_of(texts):
            w = words(part)
            parts.append(whole.slice(at, len(part)))
            words_of.append((w.ptr, *score(w, model), w.end - w.start))
            held += len(w.start)
            if held >= GROUP_WORDS:
                yield from flush()
                parts, words_of, held = [], [], 0
    if parts:
        yield from flush()


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Fit a model on at most ``per_language`` rows of each language label."""
    labelled = docs.select(of(docs, doc_id).alias("_id"), of(docs, text).alias("_text"), of(docs, lang).cast("string").alias("_key")).where("_key is not null and _text is not null")
    # ids first; texts are read for the chosen ones only
    chosen = sized(bounded(labelled.where("_id is not null").select("_id", "_key"), per_language))
    rows = labelled.join(chosen, ["_id", "_key"]).select("_key", "_text").distinct()
    return fit(sorted((r[0], r[1]) for r in rows.collect()))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = PENALTY, known_share: float = KNOWN_SHARE) -> DataFrame:
    """(doc_id, lang, share, words, spans, keep) for every row."""
    every = pa.array(model.languages, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names, share, total, known, (offsets, which, first, count) in grouped(batches, lambda b: b.column(1), model, penalty):
            spans = pa.StructArray.from_arrays([every.take(pa.array(which)), pa.array(first, pa.int32()), pa.array(count, pa.int32())], names=["lang", "first_word", "words"])
            keep = [n is not None and s >= known_share for n, s in zip(names, known.tolist(), strict=True)]
            columns = [part.column(0), pa.array(names, pa.string()), pa.array(np.round(share, 6)), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array(keep, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "share", "words", "spans", "keep"])

    rows = small_batches(docs).select(of(docs, doc_id).alias("doc_id"), of(docs, text).alias("text"))
    return rows.mapInArrow(run, typed(id_field(docs, doc_id, "doc_id"), f"lang string, share double, words long, spans {SPANS}, keep boolean"))


def keep(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, known_share: float = KNOWN_SHARE) -> DataFrame:
    """The rows of ``docs`` that known languages explain, however many; all columns unchanged."""
    at = docs.columns.index(text)  # the text travels once, inside the row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names, _, _, known, _ in grouped(batches, lambda b: b.column(0).field(at), model, penalty):
            stay = np.flatnonzero([n is not None and s >= known_share for n, s in zip(names, known.tolist(), strict=True)])
            yield part if len(stay) == part.num_rows else part.take(pa.array(stay, pa.int64()))

    rows = wrapped(small_batches(docs))
    return rows.mapInArrow(run, rows.schema).select("_row.*")
