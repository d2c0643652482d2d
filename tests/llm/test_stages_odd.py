"""All five stages on nulls, empty and long texts, ties, repeated rows, clashing names and an empty table, one by one and in a row."""

import collections
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from plethora.llm import bpe, mixing
from plethora.sources.shared import fresh_path

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_language_id(spark, odd, empty):
    kept = STAGES["language_id"](spark, odd, "")
    assert kept.columns == odd.columns and not rows_of(kept) - rows_of(odd)
    letters = [r for r in odd.collect() if re.search(r"[A-Za-z]", r["text"] or "")]
    assert rows_of(kept) <= collections.Counter(map(tuple, letters)) and 0.7 * len(letters) <= kept.count()
    assert STAGES["language_id"](spark, empty, "").collect() == []


def test_line_dedup(spark, odd, empty):
    lines = STAGES["line_dedup"](spark, odd, "")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = collections.defaultdict(list)
    source = odd.collect()
    for r in source:
        for k in {key(x) for x in (r["text"] or "").split("\n")}:
            holders[k].append(r["doc_id"] if r["doc_id"] is not None else -1)
    gone = lambda x, i: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i
    want = collections.Counter()
    for r in source:
        i = r["doc_id"] if r["doc_id"] is not None else -1
        text = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if not gone(x, i))
        want[tuple(text if c == "text" else r[c] for c in odd.columns)] += 1
    assert rows_of(lines) == want and lines.columns == odd.columns
    assert STAGES["line_dedup"](spark, empty, "").collect() == []


def test_mixing(spark, odd, empty):
    drawn = {tuple(r["row"]): r["n_copies"] for r in mixing.mix(odd).collect()}
    repeats = rows_of(odd)
    assert rows_of(STAGES["mixing"](spark, odd, "")) == collections.Counter({r: n * repeats[r] for r, n in drawn.items()})
    same = collections.defaultdict(set)
    for r, n in drawn.items():
        same[(r[0], r[3]) if r[0] is not None else (r[1], r[3])].add(n)
    assert all(len(n) == 1 for n in same.values())
    mixed = STAGES["mixing"](spark, empty, "")
    assert mixed.collect() == [] and mixed.columns == odd.columns


def test_bpe(spark, odd, empty):
    from pyspark.sql import functions as F

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = STAGES["bpe"](spark, odd.withColumn("ids", F.lit("clash")), "")
    assert out.columns == [*odd.columns, "ids"] and all(r["ids"] == enc.encode_ordinary(r["text"] or "") for r in out.collect())
    back = bpe.decode_column(out, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, text_col="again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back) and len(back) == odd.count()
    assert STAGES["bpe"](spark, empty, "").collect() == []


def test_all_in_a_row(spark, odd, empty):
    for docs in (odd, empty):
        folder = fresh_path(spark, "odd")
        docs.write.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == [*docs.columns, "ids"]
        got = out.collect()
        assert not got if docs is empty else all(r["text"] is not None and len(r["ids"]) > 0 or r["text"] == "" for r in got)
