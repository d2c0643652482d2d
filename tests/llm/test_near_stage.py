import collections
import itertools
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from plethora.llm import bpe, minhash, mixing
from plethora.llm.shingles import PERMUTATIONS, band_rows
from tests.conftest import SF
from tests.llm.test_minhash import shingles


def smallest_ids(rows, percent):
    """The smallest id of each group that links of this similarity connect, by all pairs."""
    sets, least = [shingles(t) for _, t in rows], {i: i for i, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (n := len(sets[a] & sets[b])) and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[rows[a][0]], least[rows[b][0]])
            for i in (rows[a][0], rows[b][0]):
                changed |= least[i] != low
                least[i] = low
    return sorted(set(least.values()))


def copies():
    """Pairs around the two thresholds, and one large bucket of copies."""
    r, words, rows = random.Random(8), [f"w{k}" for k in range(5000)], []
    for g in range(80):
        base = [r.choice(words) for _ in range(150)]
        other = list(base)
        for k in range(r.choice([2, 3, 4])):
            other[10 + 40 * k] = "new"
        rows += [" ".join(base), " ".join(other)]
    base = [r.choice(words) for _ in range(150)]
    for _ in range(40):
        t = list(base)
        for _ in range(r.choice([1, 2, 3])):
            t[r.randrange(150)] = r.choice(words)
        rows.append(" ".join(t))
    return list(enumerate(rows))


def test_stage_against_all_pairs(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at_80, at_85 = smallest_ids(rows, 80), smallest_ids(rows, 85)
    assert len(at_80) < len(at_85) - 10
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()) == at_80
    assert sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect()) == at_85


def test_bands_find_pairs_at_the_threshold():
    assert [band_rows(p) for p in (80, 85)] == [5, 6]
    assert all((1 - (p / 100) ** band_rows(p)) ** (2 * PERMUTATIONS // band_rows(p)) <= 1e-5 for p in range(10, 101))


def test_stage_and_those_after_it(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    near = stages["near_dedup"](spark, docs, SF).cache()
    assert sorted(r["doc_id"] for r in near.collect()) == smallest_ids([(r["doc_id"], r["text"]) for r in docs.collect()], 80) and near.columns == docs.columns
    mix = stages["mixing"](spark, near, SF).cache()
    assert collections.Counter(r["doc_id"] for r in mix.collect()) == collections.Counter({r["row"]["doc_id"]: r["n_copies"] for r in mixing.mix(near).collect()})
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(r["ids"] == enc.encode_ordinary(r["text"]) for r in stages["bpe"](spark, mix, SF).collect())
