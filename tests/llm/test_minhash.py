import itertools
import random
import re

import pytest

from plethora.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(b)] = find(a)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    return sets, groups


def near_copies():
    r, words = random.Random(5), [f"w{k}" for k in range(5000)]
    base, rows = [r.choice(words) for _ in range(150)], []
    for _ in range(110):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            t[r.randrange(150)] = r.choice(words)
        rows.append(" ".join(t))
    for g in range(30):
        t = [r.choice(words) for _ in range(r.choice([1, 3, 5, 40, 200]))]
        rows += [" ".join(t), " ".join(t).upper()] + [" ".join([*t[: len(t) // 2], "zz", *t[len(t) // 2 + 1 :]])] * (g % 3 == 0)
    return list(enumerate([*rows, "", None, " \n"]))


@pytest.mark.parametrize("block,small", [(512, 8), (16, 4)])
def test_components_against_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SMALL", small)
    rows = near_copies()
    got = {r["id"]: r for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, groups = brute(rows)
    for ids in groups.values():
        assert {got[k]["component"] for k in ids} == {min(ids)}
        assert [k for k in ids if got[k]["stays"]] == [min(ids)]
    assert all(got[k]["n"] == len(s) for k, s in enumerate(sets))


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _, groups = brute(rows)
    got = minhash.near_groups(odd).collect()
    assert len(got) == len(rows) and sum(r["stays"] for r in got) == len(groups)
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() >= 1
    assert minhash.near_groups(empty).count() == 0 and minhash.one_of_each(empty).count() == 0


def test_one_of_each_keeps_columns(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(near_copies(), "doc_id long, text string").withColumn("g_id", F.lit(1)).withColumn("row", F.lit("x"))
    kept = minhash.one_of_each(d)
    _, groups = brute(near_copies())
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())
