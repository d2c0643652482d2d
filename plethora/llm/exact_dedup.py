"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests.

A snapshot is an immutable pair of tables: its digest groups (one row per distinct text) cut into buckets by digest, and one
filter a bucket. ``write_snapshot`` stores both under a path and ``open_snapshot`` reads them again, so filters are built once.
An incoming batch is first grouped by itself. Its groups then meet the filters, bucket by bucket, and carry their keeper and
count along: what a filter doesn't let pass is new and done after that one shuffle. The few that pass join the snapshot's exact
groups. ``exact_groups`` takes one half of a table, dealt by a hash of the id, as the snapshot and the other as the batch.

Two texts are equal when they are identical after each run of white space is replaced by one space. Of equal texts the
row with the smallest id stays. Under digests that several rows share, the texts themselves are grouped and counted, so
texts that differ never share a group, whatever their digests.

Scale: the digest table (about 50 bytes a row) is written once to the shared folder. Groups are summed before the shuffle,
so a group that holds a third of all rows is one row a task, in the byte check as well. A bucket holds about ``BUCKET``
digests at any input size, as the number of buckets follows the number of digests, and a large batch meets each filter in
several parts. Of the texts only those of groups with copies are shuffled, picked by a broadcast of at most ``BROADCAST``
digests and by a join beyond; the join that brings the groups back to the rows is between tables, so that adaptive execution
splits the partition of a large group.

Defined results: null counts as the empty text; null ids come after all others; of rows that tie on the smallest id,
one stays (the first in the digest table), the others get the same keep_id and kept = false. Ids may be of any type that
sorts. Extra columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plethora.llm import fuse
from plethora.llm.common import column, settled, staged, table

#: Digests in a bucket, about; digests that are broadcast at most (16 MB).
BUCKET, BROADCAST = 100_000, 500_000


def normalised(text_col: str = "text") -> Column:
    # Runs of two or more and single characters other than the space; a single space stays as it is.
    return F.regexp_replace(F.coalesce(column(text_col), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, digest (binary SHA-256 of the normalised text), in the shared folder."""
    return staged(docs.select(F.monotonically_increasing_id().alias("rid"), column(id_col).alias("id"), digest_of(normalised(text_col)).alias("digest")), "digests")


def _first() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "rid")).alias("keeper")


def grouped(digests: DataFrame) -> DataFrame:
    """One row per distinct digest: keeper (the row that stays), and n, the number of rows."""
    return digests.groupBy("digest").agg(_first(), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Snapshot:
    """groups (digest, keeper, n) and filters (bucket, cells) of an immutable set of texts, cut into so many buckets."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(buckets)).cast("int")


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x)[:8] for x in digests), "<u8")


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """bucket, cells: one filter per bucket of the groups' digests."""

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "cells": [fuse.build(_keys(pdf["digest"]))]})

    return groups.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(make, "bucket int, cells binary")


def write_snapshot(groups: DataFrame, path: str) -> Snapshot:
    """Stores the groups (of grouped() or merge()) and their filters under the path, which must be new."""
    groups.write.option("compression", "zstd").parquet(f"{path}/groups")
    known = groups.sparkSession.read.schema(groups.schema).parquet(f"{path}/groups")
    buckets = max(1, -(-known.count() // BUCKET))
    build_filters(known, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")
    return open_snapshot(groups.sparkSession, path)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    filters = spark.read.schema("bucket int, cells binary, buckets int").parquet(f"{path}/filters")
    one = filters.select("buckets").head()
    return Snapshot(spark.read.parquet(f"{path}/groups"), filters.select("bucket", "cells"), one[0] if one else 1)


def screen(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """incoming (digest, keeper, n; distinct digests) with maybe: whether the snapshot's filter lets the digest pass.

    Each row moves once. A batch much larger than the snapshot meets each filter in as many parts as keep a group at about BUCKET rows.
    """
    parts = max(1, -(-incoming.count() // (snapshot.buckets * BUCKET)))

    def probe(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        maybe = fuse.contains(right["cells"].iloc[0], _keys(left["digest"])) if len(right) and len(left) else np.zeros(len(left), bool)
        return left[["digest", "null_id", "id", "rid", "n"]].assign(maybe=maybe)

    mine = incoming.select(_bucket(snapshot.buckets).alias("bucket"), F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(parts)).cast("int").alias("part"), "digest", "keeper.*", "n")
    theirs = snapshot.filters.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cells")
    schema = mine.select("digest", "null_id", "id", "rid", "n", F.lit(True).alias("maybe")).schema
    found = mine.groupBy("bucket", "part").cogroup(theirs.groupBy("bucket", "part")).applyInPandas(probe, schema)
    return found.select("digest", F.struct("null_id", "id", "rid").alias("keeper"), "n", "maybe")


def merge(snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """The groups of both: digest, keeper (the first of both keepers), n. incoming is a staged frame of grouped()."""
    screened = staged(screen(incoming, snapshot), "screened")
    positive = screened.where("maybe").select("digest", F.col("keeper").alias("other"), F.col("n").alias("more"))
    few = positive.count() <= BROADCAST
    held = snapshot.groups.join(F.broadcast(positive) if few else positive, "digest", "left").select(
        "digest", F.least("keeper", "other").alias("keeper"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("other").isNotNull().alias("hit"))
    held = staged(held, "held")
    # What the filter let pass without being there is new too.
    hits = held.where("hit").select("digest")
    false = screened.where("maybe").join(F.broadcast(hits) if few else hits, "digest", "left_anti")
    fresh = screened.where("NOT maybe").select("digest", "keeper", "n").union(false.select("digest", "keeper", "n"))
    return held.select("digest", "keeper", "n").union(fresh)


def differing(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, digest, norm of all rows under digests that texts with different bytes share; no rows, but for broken digests.

    Texts of groups with copies are grouped by their bytes, map side first, and counted; rids are new ones.
    """
    copies = staged(groups.where("n > 1").select("digest"), "copied")
    mine = docs.select(column(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("digest", digest_of(F.col("norm")))
    copied = mine.join(F.broadcast(copies) if copies.count() <= BROADCAST else copies, "digest", "left_semi")
    texts = copied.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    broken = staged(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "broken")
    return mine.join(F.broadcast(broken) if broken.count() <= BROADCAST else broken, "digest", "left_semi").select(F.monotonically_increasing_id().alias("rid"), "id", "digest", "norm")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, keep_id, n, kept for every row."""
    return settled(docs.sparkSession, "exact", lambda: _exact(docs, id_col, text_col))


def _exact(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    from plethora.sources.shared import fresh_path

    digests = digest_table(docs, id_col, text_col)
    old = F.coalesce(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(2)) == 0, F.lit(False))
    snapshot = write_snapshot(grouped(digests.where(old)), fresh_path(docs.sparkSession, "snapshot"))
    groups = staged(merge(snapshot, staged(grouped(digests.where(~old)), "incoming")), "groups")
    told = lambda rows, found, *on: rows.join(found, [*on]).select("id", "digest", F.col("keeper.id").alias("keep_id"), "n", (F.col("rid") == F.col("keeper.rid")).alias("kept"))
    odd = staged(differing(docs, groups, id_col, text_col), "differing")
    if odd.isEmpty():
        return told(digests, groups, "digest")
    broken = staged(odd.select("digest").distinct(), "broken")
    apart = staged(odd.groupBy("digest", "norm").agg(_first(), F.count(F.lit(1)).alias("n")), "apart")
    return told(digests.join(broken, "digest", "left_anti"), groups, "digest").union(told(odd, apart, "digest", "norm"))


def query(spark, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
