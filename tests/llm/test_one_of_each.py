"""What the near_dedup stage keeps of odd tables, held against all pairs."""

import collections
import itertools

import corpus_pipeline
from plethora.llm import minhash
from tests.llm.test_minhash import shingles

NEAR = dict(corpus_pipeline.STAGES)["near_dedup"]


def groups_at(percent, texts):
    """Numbers of the texts that links of this similarity connect, by all pairs."""
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            group = [group[a] if g == group[b] else g for g in group]
    found = collections.defaultdict(list)
    for k, g in enumerate(group):
        found[g].append(k)
    return found


def checked(spark, docs):
    """One row of each group stays, one with the group's smallest id; rows without words all stay. Whole rows are compared."""
    rows = [tuple(r) for r in docs.collect()]
    at = [docs.columns.index(c) for c in ("doc_id", "text")]
    kept = NEAR(spark, docs, "")
    assert kept.columns == docs.columns
    got = collections.Counter(tuple(r) for r in kept.collect())
    assert not got - collections.Counter(rows)
    groups = groups_at(corpus_pipeline.NEAR, [r[at[1]] for r in rows])
    wanted = 0
    for own in groups.values():
        known = [rows[k][at[0]] for k in own if rows[k][at[0]] is not None]
        least = min(known) if known else None
        firsts = collections.Counter(rows[k] for k in own if rows[k][at[0]] == least)
        assert sum((firsts & got).values()) >= 1
        wanted += 1
    assert sum(got.values()) == wanted
    return got


def test_odd_and_empty(spark, odd, empty):
    checked(spark, odd)
    assert NEAR(spark, empty, "").collect() == [] and NEAR(spark, empty, "").columns == empty.columns


def test_repeated_ids_of_rows_without_words(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(5, "", "a"), (5, "", "b"), (6, None, "c"), (6, "", "d"), (7, words, "e"), (7, words, "e"), (None, words.upper(), "f"), (None, " \n", "g"), (None, None, "g"), (3, words + " more", "h")]
    got = checked(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(got[r] == 1 for r in rows if not shingles(r[1])) and sum(got.values()) == 7


def test_rows_that_stay_are_those_that_come_back(spark, odd):
    near = minhash.near_groups(odd, percent=corpus_pipeline.NEAR).collect()
    back = collections.Counter(r["doc_id"] for r in NEAR(spark, odd, "").collect())
    assert back == collections.Counter(r["id"] for r in near if r["stays"])


def test_side_tables_are_deleted(spark, odd):
    import pathlib

    from plethora.sources.shared import application_folder

    folder = pathlib.Path(application_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = minhash.near_groups(odd)
    assert len(set(folder.iterdir()) - before) == 1 and found.count() == odd.count()
