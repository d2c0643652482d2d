"""Stored snapshots, what they screen, and digests that different texts share."""

from pyspark.sql import functions as F

from plethora.llm import exact_dedup as ed
from plethora.sources.shared import fresh_path


def _groups(spark, texts, start=0):
    docs = spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return ed.staged(ed.grouped(ed.digest_table(docs)), "g")


def test_a_snapshot_is_read_again_and_screens(spark, monkeypatch):
    monkeypatch.setattr(ed, "BUCKET", 50)
    path = fresh_path(spark, "snap")
    ed.write_snapshot(_groups(spark, [f"text {k}" for k in range(300)]), path)
    snapshot = ed.open_snapshot(spark, path)
    assert snapshot.buckets == 6 and snapshot.filters.count() == 6
    incoming = _groups(spark, [f"text {k}" for k in range(280, 1300)] + ["text 290"], start=-50)
    maybe = {bytes(r["digest"]): r["maybe"] for r in ed.screen(incoming, snapshot).collect()}
    held = {bytes(r["digest"]) for r in snapshot.groups.collect()}
    assert len(maybe) == 1020 and all(maybe[d] for d in maybe.keys() & held) and sum(maybe[d] for d in maybe.keys() - held) < 30
    merged = {bytes(r["digest"]): (r["keeper"]["id"], r["n"]) for r in ed.merge(snapshot, incoming).collect()}
    assert len(merged) == 1300
    digest = {t: bytes(d) for t, d in spark.createDataFrame([(f"text {k}",) for k in range(1300)], "t string").select("t", ed.digest_of(F.col("t"))).collect()}
    assert merged[digest["text 0"]] == (0, 1) and merged[digest["text 290"]] == (-40, 3) and merged[digest["text 281"]] == (-49, 2) and merged[digest["text 1000"]] == (670, 1)


def test_texts_under_one_digest_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(ed, "digest_of", lambda norm: F.unhex(F.concat(F.substring(F.sha2(norm, 256), 1, 1), F.lit("0" * 63))))
    texts = [f"words {k % 40}" for k in range(120)] + ["words  7", None, "", "\n", " "]
    docs = spark.createDataFrame([(k if k != 11 else None, t) for k, t in enumerate(texts)] + [(3, "words 3")], "doc_id long, text string")
    want = {}
    for r in docs.collect():
        want.setdefault(" ".join((r["text"] or "").replace("\n", " ").replace("  ", " ").split(" ")), []).append(r["doc_id"])
    got = sorted((r["keep_id"], r["n"], r["id"] is None, r["id"] or 0) for r in ed.exact_groups(docs).collect())
    assert got == sorted((min(i for i in ids if i is not None), len(ids), i is None, i or 0) for ids in want.values() for i in ids)
    assert sum(r["kept"] for r in ed.exact_groups(docs).collect()) == len(want)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x\ty"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    assert sorted((r["id"] or "", r["keep_id"], r["n"], r["kept"]) for r in ed.exact_groups(docs).collect()) == [("", "a", 3, False), ("a", "a", 3, True), ("b", "a", 3, False), ("c", "c", 1, True)]
