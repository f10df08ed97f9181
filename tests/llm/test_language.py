"""Language identification: Viterbi against enumeration, held-out accuracy, spans of mixed texts."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from sparkfold.llm import langid
from sparkfold.llm.frames import table
from sparkfold.llm.words import words


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(0, 7, 5)
        ptr = np.concatenate(([0], np.cumsum(sizes)))
        scores = rng.normal(0, 3, (ptr[-1], 3)).astype(np.float32)
        path = langid.viterbi(scores, ptr, 2.0)
        for lo, hi in itertools.pairwise(ptr):
            def total(p, lo=lo):
                return sum(scores[lo + i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))

            if hi > lo:
                best = max(total(p) for p in itertools.product(range(3), repeat=int(hi - lo)))
                assert abs(total(path[lo:hi].tolist()) - best) < 1e-4


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return [(r[0], r[1]) for r in table(spark, "/root/testdata/sf0.01", "documents").select("lang", "text").orderBy("doc_id").collect()]


def test_held_out_accuracy(labelled):
    model = langid.fit(labelled[:500])
    w = words(pa.array([t for _, t in labelled[500:]]))
    names, share, _, _ = langid.label(w.ptr, *langid.score(w, model), model)
    right = [a == b for a, (b, t) in zip(names, labelled[500:], strict=True) if len(t) >= 40]
    assert np.mean(right) >= 0.97


def test_mixed_spans(spark, labelled):
    model = langid.fit(labelled[:500])
    de, en = (next(" ".join(t.split()[:40]) for lang, t in labelled[500:] if lang == x and len(t.split()) > 60) for x in ("de", "en"))
    text = f"{de} {en} Быстрая коричневая лиса прыгает через ленивую собаку"
    row = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["de", "en", "ru"]
    assert sum(s["words"] for s in row["spans"]) == row["words"]
    assert abs(row["spans"][1]["first_word"] - len(words(pa.array([de])).start)) <= 2


def test_messy(messy, empty, labelled):
    model = langid.fit(labelled[:300])
    got = {(r["doc_id"], r["lang"], r["keep"]) for r in langid.identify(messy, model).collect()}
    for i in (4, 5, 6, 7, 8):
        assert (i, None, False) in got
    assert (12, "ru", True) in got
    kept = langid.keep(messy, model)
    assert kept.columns == messy.columns and {r[0] for r in kept.select("doc_id").collect()} >= {1, 2, 3, 10, 11, 12, None}
    assert langid.identify(empty, model).count() == 0 and langid.keep(empty, model).count() == 0
    assert langid.train(messy).languages and langid.train(empty).trained == 0
    blank = langid.train(empty)
    assert {(r["doc_id"], r["lang"]) for r in langid.identify(messy, blank).collect()} >= {(12, "ru"), (1, "und"), (8, None)}


def test_batches_do_not_matter(spark, labelled):
    model = langid.fit(labelled[:300])
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(labelled[300:400])], "doc_id long, text string")
    a = sorted(map(tuple, langid.identify(docs.coalesce(1), model).select("doc_id", "lang", "share", "words").collect()))
    b = sorted(map(tuple, langid.identify(docs.repartition(7), model).select("doc_id", "lang", "share", "words").collect()))
    assert a == b


def plain_viterbi(scores, penalty):
    """One text, one state at a time."""
    v, back = scores[0].astype(float), []
    for row in scores[1:]:
        top = int(v.argmax())
        stay = v >= v[top] - penalty
        back.append([s if stay[s] else top for s in range(len(v))])
        v = np.maximum(v, v[top] - penalty) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("languages", [2, 57, 60, 70, 300])
def test_viterbi_with_many_languages(languages):
    rng = np.random.default_rng(languages)
    sizes = rng.integers(1, 40, 12)
    ptr = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(0, 3, (ptr[-1], languages)).astype(np.float32)
    path = langid.viterbi(scores, ptr, 4.0)
    for lo, hi in itertools.pairwise(ptr):
        assert path[lo:hi].tolist() == plain_viterbi(scores[lo:hi], 4.0)


def test_ranges_do_not_overlap():
    spans = sorted((int(r.split("-")[0], 16), int(r.split("-")[-1], 16)) for ranges in langid.RANGES.values() for r in ranges.split())
    assert all(a <= b < c for (a, b), (c, _) in itertools.pairwise(spans))


SCRIPTED = {
    "zh": "中文是一种语言 我们 今天 去 学校 学习", "ja": "私は学生です 今日 東京 へ行きます 日本語 を話します", "ko": "저는 학생입니다 오늘 학교 에 갑니다", "ru": "мы идём сегодня в школу", "uk": "ми йдемо сьогодні до школи і її друзів їжак",
    "ar": "نحن نذهب اليوم إلى المدرسة", "fa": "ما امروز به مدرسه می رویم چرا پدر گفت", "hi": "हम आज स्कूल जा रहे हैं", "hy": "մենք այսօր գնում ենք դպրոց", "ka": "ჩვენ დღეს სკოლაში მივდივართ", "ta": "நாங்கள் இன்று பள்ளிக்கு செல்கிறோம்",
    "bn": "আমরা আজ স্কুলে যাচ্ছি", "th": "เรา ไป โรงเรียน วันนี้", "el": "πηγαίνουμε σήμερα στο σχολείο", "he": "אנחנו הולכים היום לבית הספר", "am": "ዛሬ ወደ ትምህርት ቤት እንሄዳለን", "und": "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᏂᏴᏫᏯ",
}


def test_scripts_without_training_rows(spark, labelled):
    """Every script has its language; Han without kana is Chinese; letters of no known script are und; all of them stay."""
    for model in (langid.fit(labelled[:300]), langid.fit([])):
        docs = spark.createDataFrame([(k, t) for k, t in SCRIPTED.items()], "doc_id string, text string")
        got = {r["doc_id"]: (r["lang"], r["keep"]) for r in langid.identify(docs, model).collect()}
        assert got == {k: (k, True) for k in SCRIPTED}
        assert langid.keep(docs, model).count() == len(SCRIPTED)


def test_symbols_and_numbers_are_no_words(spark, labelled):
    docs = spark.createDataFrame([(1, "2024 17 ٣٤"), (2, "☃ ★ ❤"), (3, "the house ★ ★ ★ ★ of my old friend 2024"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang"], r["keep"]) for r in langid.identify(docs, langid.fit(labelled[:500])).collect()}
    assert got[1] == got[2] == got[4] == (None, False) and got[3][1]


def test_odd_column_names(spark, labelled):
    odd = spark.createDataFrame([(1, SCRIPTED["zh"], 1, "x", 2.0, True, "k")], ["doc_id", "text", "a.b", "x y", "q:z", "a-b", "b`t"])
    kept = langid.keep(odd, langid.fit(labelled[:300]))
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in odd.collect()]
    nested = odd.selectExpr("named_struct('a b', doc_id) AS doc_id", "text")
    assert langid.identify(nested, langid.fit(labelled[:300])).first()["doc_id"][0] == 1
