from pyspark.sql import functions as F

from plethora.llm import secret_scan


def test_a_copied_opaque_token_keeps_its_span_and_class(spark):
    rows = [(k, "key Ab1Cd2Ef3Gh4Ij5Kl6Mn7 end", f"s{k}") for k in range(3)] + [(3, "key Zz9Yy8Xx7Ww6Vv5Uu4Tt3 end", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, "text", F.col("doc_id"), F.col("source"), F.col("doc_id")).collect()}
    assert all([(s["kind"], s["start"], s["end"], s["n_owners"], s["n_repos"], s["live"]) for s in got[k]] == [("live", 4, 25, 3, 3, False)] for k in range(3))
    assert [(s["kind"], s["start"], s["end"], s["n_owners"], s["live"]) for s in got[3]] == [("live", 4, 25, 1, True)]
