"""Texts in several languages stay; texts that no language explains don't."""

import random

from sparkfold.llm import langid
from sparkfold.llm.frames import table


def test_mixed_texts_stay(spark):
    labelled = [(r[0], r[1]) for r in table(spark, "/root/testdata/sf0.01", "documents").select("lang", "text").orderBy("doc_id").collect()]
    model = langid.fit(labelled[:500])
    de, en = (next(" ".join(t.split()[:40]) for lang, t in labelled[500:] if lang == x and len(t.split()) > 60) for x in ("de", "en"))
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("qxzjkvwy", k=8)) for _ in range(60))
    mixed = f"{de} {en} Быстрая коричневая лиса прыгает через ленивую собаку"
    texts = [mixed, noise, f"{noise} the dog", f"{noise} აბგ დევ ზთი კლმ", f"{en} " + "2024 17 3.5 " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert rows[0]["share"] < 0.5 and rows[0]["keep"]
    assert {i for i, r in rows.items() if r["keep"]} == {0, 4} == {r[0] for r in langid.keep(docs, model).collect()}
