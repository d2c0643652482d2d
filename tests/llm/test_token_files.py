"""Token files against the tokenizers library on whole texts, and what the files hold."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plethora.llm import token_files
from plethora.sources.shared import fresh_path
from tests.conftest import SF

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def wanted(model, rows):
    """(doc_id, start, n, crc) of rows (doc_id, text) in their order."""
    found, start = [], 0
    for i, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        found.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_query_against_the_library(spark, model):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(map(tuple, token_files.query(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == wanted(model, rows)


TEXTS = [
    "éa ́b Å", "각 ᆨx", "a b c d\x85e", "x\x1cy\x1fz", "<|endoftext|> a<|startoftext|>b", "I'LL can't  'S", "ΑΣ Σ ΣΑΣ İI", "﻿​‍", "1 22 3.4e5",
    "\U0001f468‍\U0001f469‍\U0001f467 \U0001f1e9\U0001f1ea", "ﬁ ǅ ẞ", "\n\n\t\x0b\x0c\r", "", "a" * 5000 + " " + "é" * 300, "one. One, ONE; 7 1.7 a7. x77 don't. 'S! it's? é. 5. ... .a 7", "<|endoftext|>. <|ENDOFTEXT|> <|startoftext|>7 <", "K; µ. \u037e \u1fef", "̈́ ཱིི क़", "日本語 テキスト"]


@pytest.mark.parametrize("ordinary", [False, True])
def test_words_give_the_ids_of_whole_texts(model, ordinary):
    with open(PATH, encoding="utf-8") as file:
        coder = token_files.WordEncoder(file.read(), "<u2", 1, ordinary)
    model.encode_special_tokens = ordinary
    assert coder.lower and coder.alone and len(coder.stops) == 6
    for texts in (TEXTS, TEXTS[::-1], [" ".join(TEXTS)], TEXTS):
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)] == [[*model.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    model.encode_special_tokens = False
    assert not any(len(w) > token_files.WORD_BYTES for w in coder.known)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 10)
    with open(PATH, encoding="utf-8") as file:
        coder = token_files.WordEncoder(file.read(), "<u2", 1)
    one = coder.encode([" ".join(f"w{k}" for k in range(40))])
    assert len(coder.known) + len(coder.older) <= 40 and coder.encode([" ".join(f"w{k}" for k in range(40))]) == one


def test_odd_rows_files_and_stream(spark, odd, model):
    path = fresh_path(spark, "tokens")
    shards = token_files.write_tokens(odd, path, PATH, shards=5)
    rows = odd.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))]
    want = wanted(model, rows)
    got = sorted(token_files.documents(spark, path, with_ids=True).collect(), key=lambda r: r["doc_no"])
    assert [tuple(r)[1:5] for r in got] == want and [r["doc_no"] for r in got] == list(range(len(rows)))
    every = [x for r in got for x in r["ids"]]
    assert all(r["ids"] == [*model.encode(t or "", add_special_tokens=False).ids, 1] for r, (_, t) in zip(got, rows))
    files = token_files.TokenFiles(path)
    assert (files.n_docs, files.n_tokens) == (len(rows), len(every)) and shards.count() > 1
    assert all(files.doc(k).tolist() == got[k]["ids"] for k in range(len(rows)))
    for start, n in ((0, len(every)), (3, 5), (want[4][1] - 2, 40000), (len(every) - 1, 10), (len(every), 5)):
        assert files.span(start, n).tolist() == every[start : start + n]
    with pytest.raises(IndexError):
        files.doc(len(rows))


def test_one_id_of_most_rows_is_spread(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    shards = token_files.write_tokens(docs, fresh_path(spark, "tokens"), PATH, shards=8).collect()
    assert len(shards) >= 7 and max(r["n_docs"] for r in shards) < 1500 and sum(r["n_docs"] for r in shards) == 4000
    by = sorted(shards, key=lambda r: r["part"])
    assert [r["first_token"] for r in by] == [sum(x["n_tokens"] for x in by[:k]) for k in range(len(by))]


def test_empty_table_and_wide_ids(spark, empty, odd):
    path = fresh_path(spark, "tokens")
    assert token_files.write_tokens(empty, path, PATH).count() == 0 and token_files.documents(spark, path).count() == 0
    assert token_files.TokenFiles(path).span(0, 5).tolist() == []
    with pytest.raises(ValueError, match="no place"):
        token_files.write_tokens(odd, path, PATH, end=70000)
