"""Keys that a third of all rows hold: the joins on them are between tables, so that adaptive execution splits them."""

from plethora.llm import exact_dedup, minhash
from plethora.llm.common import staged


def test_copies_of_one_text(spark, skewed):
    docs = spark.createDataFrame([(k, "the same text" if k % 3 == 0 else f"text {k}") for k in range(6000)], "doc_id long, text string").repartition(40)
    digests = exact_dedup.digest_table(docs)
    groups = staged(exact_dedup.grouped(digests), "groups")
    assert skewed(digests.join(groups, "digest"))
    found = exact_dedup.exact_groups(docs)
    assert found.where("n = 2000 AND keep_id = 0").count() == 2000 and found.where("kept").count() == 4001


def test_a_hub_of_pairs(spark, skewed):
    """One set is in most pairs, on the side that is joined last."""
    sets = spark.createDataFrame([(f"{k:05d}".encode(), [1, 2, 3, 1000 + k]) for k in range(3000)], "node binary, shingles array<long>").repartition(40)
    pairs = spark.createDataFrame([(f"{k:05d}".encode(), b"02999" if k % 3 == 0 else f"{k + 1:05d}".encode()) for k in range(2998)], "a binary, b binary").repartition(40)
    found = minhash.confirmed(staged(pairs, "pairs"), staged(sets, "sets"), 60)
    assert skewed(found) and found.count() == 2998
