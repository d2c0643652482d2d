import random

import pyarrow as pa

from plethora.llm import language_id, toxicity
from tests.conftest import SF


def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in language_id.query(spark, SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert len(got) == len(lang) and sum(got[d]["lang_pred"] == lang[d] for d in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and sum(r["rejected"] for r in got.values()) <= 0.02 * len(got)


def test_language_of_odd_rows(odd, empty):
    model = language_id.fit(odd)
    got = language_id.predict(odd, model).collect()
    for r in got:
        text = r["text"]
        letters = text is not None and any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in {"en", "de", "fr", "und"}
        assert letters or r["rejected"]
    assert language_id.accepted(odd, model).columns == odd.columns
    assert language_id.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(empty)).collect()} == {"und"}


def test_long_texts_are_read_whole(monkeypatch):
    model = language_id.train(["the and of to " * 20] * 30 + ["der und die das " * 20] * 30, ["en"] * 30 + ["de"] * 30)
    text = "the and of to " * 40 + "der und die das " * 4000
    whole = model.predict(pa.array([text, "the and of to"]))
    monkeypatch.setattr("plethora.llm.subword.PIECE", 1000)
    pieces = model.predict(pa.array([text, "the and of to"]))
    assert [model.languages[k] for k in whole[0]] == ["de", "en"] and whole[0].tolist() == pieces[0].tolist() and abs(whole[1] - pieces[1]).max() < 1e-3


def _texts(n, toxic, seed):
    r = random.Random(seed)
    harmless = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(300)]
    bad = ["idiot", "worthless", "disgusting", "pathetic"]
    made = []
    for _ in range(n):
        words = [r.choice(harmless) for _ in range(r.randint(5, 200))]
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        made.append(" ".join(words))
    return made


def test_toxic_words_and_misspellings():
    model = toxicity.train(_texts(300, 0, 1) + _texts(60, 1, 1), [0] * 300 + [1] * 60)
    clean, bad = model.score(pa.array(_texts(100, 0, 1))), model.score(pa.array(_texts(100, 1, 1)))
    assert (bad >= toxicity.THRESHOLD).mean() > 0.95 and (clean >= toxicity.THRESHOLD).mean() < 0.1
    odd = model.score(pa.array(["so wworthless", "PATHETIC!!", None, "", "1"]))
    assert odd[0] >= 0.3 and odd[1] >= 0.3 and (odd[2:] < 0.3).all()


def test_toxicity_query(spark):
    got = toxicity.query(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, None), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == odd.count()
    model = toxicity.fit(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0
