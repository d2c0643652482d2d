"""What language ID learns from: windows over whole texts, any number of languages, repeated rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from plethora.llm import language_id
from tests.llm.test_rejection import _texts


def test_windows_cover_the_whole_text(spark):
    text = "".join(chr(0x4E00 + k % 9000) for k in range(90_000))
    rows = spark.createDataFrame([(1, text), (2, text[:3000]), (3, "")], "key long, text string")
    got = {r["key"]: r["w"] for r in rows.select("key", language_id.windows(F.col("text"), F.col("key")).alias("w")).collect()}
    assert got[2] == text[:3000] and got[3] == ""
    parts = got[1].split(" ")
    assert len(parts) == language_id.WINDOWS and {len(p) for p in parts} == {language_id.TRAIN_CHARS // language_id.WINDOWS}
    assert all(p in text[k * 3000 : (k + 1) * 3000] for k, p in enumerate(parts))


def test_more_languages_than_dimensions(spark):
    """Each has its own twelve letters of the CJK block."""
    n, rows = 130, []
    for k in range(n):
        letters = "".join(chr(0x4E00 + 40 * k + j) for j in range(12))
        rows += [(f"l{k:03d}", t) for t in _texts(letters, 6, k)]
    docs = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == n and model.out is not None and model.rows.shape[1] == language_id.DIM
    best, _ = model.predict(pa.array([t for _, t in rows]))
    assert sum(model.languages[b] == l for b, (l, _) in zip(best, rows)) >= 0.9 * len(rows)


def test_repeated_rows_are_learned_from_once(spark):
    r = random.Random(1)
    rows = [(1, "the same text " * 5, "a")] * 3000 + [(k, t, "b") for k, t in enumerate(_texts("aeiounrt", 30, 1))] + [(None, t, "a") for t in _texts("bcdfaeio", 30, 2)]
    r.shuffle(rows)
    texts, labels = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", F.lit(True))
    assert sorted(labels) == ["a"] * 31 + ["b"] * 30 and texts.count("the same text " * 5) == 1
