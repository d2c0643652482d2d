import collections
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from plethora.llm import bpe, mixing
from tests.conftest import SF
from tests.llm.test_near_stage import smallest_ids


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    kept = stages["language_id"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()

    lines = stages["line_dedup"](spark, kept, SF).cache()
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in rows.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    want = {i: "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i)) for i, t in rows.items()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and lines.columns == docs.columns

    near = stages["near_dedup"](spark, lines, SF).cache()
    assert sorted(r["doc_id"] for r in near.collect()) == smallest_ids(sorted(want.items()), corpus_pipeline.NEAR) and near.columns == docs.columns

    mix = stages["mixing"](spark, near, SF).cache()
    counts = collections.Counter(r["doc_id"] for r in mix.collect())
    drawn = {r["row"]["doc_id"]: r["n_copies"] for r in mixing.mix(near).collect()}
    assert counts == collections.Counter(drawn) and mix.columns == docs.columns

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = stages["bpe"](spark, mix, SF)
    assert out.columns == [*docs.columns, "ids"]
    assert all(r["ids"] == enc.encode_ordinary(r["text"]) for r in out.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[-1] == "ids"
