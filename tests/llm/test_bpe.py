import random

import public_tokenizers as P
import pytest
import tiktoken

from plethora.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


def many(codec, texts):
    return [[int(x) for b in blocks for x in b.split(" ")] for blocks in codec.encode_texts(texts)]


def test_as_the_library_does(codec):
    r = random.Random(3)
    texts = ["".join(r.choice("ab \n\t'st1é ñ -_=:/xyzEAT　日\U0001f600") for _ in range(r.randint(0, 120))) for _ in range(2000)]
    assert many(codec, texts) == [TRUE.encode_ordinary(t) for t in texts]


def test_long_pieces_and_texts(codec, monkeypatch):
    for t in ("x" * 20000 + "ab" * 3000, "word " * 5000, "=" * 999):
        assert codec.encode(t) == TRUE.encode_ordinary(t)
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    texts = ["short", "a longer text of some words, " * 20, "", None, "end"]
    assert many(codec, texts) == [TRUE.encode_ordinary(t or "") for t in texts]


def test_single_tree_equals_batch(codec):
    r = random.Random(4)
    pieces = ["".join(r.choice("abcdenrst") for _ in range(r.randint(2, 60))).encode() for _ in range(500)]
    pieces = [p for p in pieces if p not in RANKS]  # whole tokens never come to the batch
    single = [bpe.merge_piece(p, RANKS) for p in pieces]
    assert bpe.merge_batch(pieces, 64, codec.pairs) == single == [TRUE.encode_ordinary(p.decode()) for p in pieces]


def test_round_trip(codec):
    for t in ("Déjà vu — 日本語 \U0001f600\n\n  x", "", "</s>[INST]"):
        assert codec.decode(codec.encode(t)).decode() == t


def test_remembered_pieces_are_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    texts = [f"piece{k} other{k * 7}" for k in range(500)]
    assert many(codec, texts) == [TRUE.encode_ordinary(t) for t in texts]
    assert len(codec.ids) <= 2200


def test_columns(spark, odd, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_column(odd, path, P.PATTERN)
    assert out.columns == [*odd.columns, "ids"]
    for r in out.collect():
        assert r["ids"] == TRUE.encode_ordinary(r["text"] or "")
    assert all(r["exact"] for r in bpe.digests(odd, path, P.PATTERN).collect())
    assert bpe.digests(empty, path, P.PATTERN).count() == 0
