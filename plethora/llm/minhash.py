"""MinHash near-dedup by min-max hashing.

Each of ``PERMUTATIONS`` hash permutations gives a text's shingle set two signature values, its minimum and its maximum, so
half the hash evaluations make a signature of the same length; each value agrees between two sets with a chance equal to
their Jaccard similarity. Neighbouring values make a band, and sets that share a band are candidates; the threshold sets
how many values (6 at 0.85, 5 at 0.80): a pair at either shares none of the bands with a chance of 7 in a million.
Candidates are confirmed on full sets.

Texts with equal sets are one node from the start, so copies make no pairs. Pairs of small buckets are listed, those that
share several bands once, and confirmed by a join with their sets. The nodes of a large bucket (many near copies) meet in
blocks of a bounded size: a task multiplies the 0/1 columns of two blocks, which gives all intersections exactly, and
returns at most one edge a node. In buckets of many blocks, rounds of hubs come first: the node that shares most buckets
is held against the nodes of other components. Two blocks of one component never meet, so a group of true near copies
takes work in proportion to its size. No partner is dropped: each pair that shares a band is compared or already connected.

Scale: rows are written once with a number of their own, by which every later pass knows them, whatever their ids. One
pass over the texts writes ids, digests and band keys (about 250 bytes a text); candidates' sets are made in a second pass
over those texts alone (by broadcast of their numbers up to ``BROADCAST``, by a join beyond). Buckets of two need no join. A
hot bucket is one row a task in its count; what is joined by bucket, set or component are tables, so that adaptive execution
splits a hot one's partition. Side tables are deleted once the result is written.

Defined results: null, empty and wordless texts have an empty set, are linked with nothing and all stay, with equal or null
ids too. Null ids come after all others. Rows with equal texts are linked, repeated rows and rows with equal ids too; of
rows that tie on the smallest id the first in the table stays. Extra columns are ignored or pass through (``one_of_each``),
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plethora.llm.common import few, packed, settled, staged, table
from plethora.llm.components import components
from plethora.llm.shingles import band_rows, bands, digest, groups, shingle_sets, signatures
from plethora.llm.subword import strings

#: A link: 100 * intersection >= PERCENT * union, unless a caller gives another percent.
PERCENT = 85
#: Nodes of a bucket up to which all its pairs are compared one by one; rounds of hubs at most.
SMALL, ROUNDS = 8, 3
#: Nodes and shingles of a block, about; columns of a product of blocks at once.
BLOCK, SHINGLES, COLUMNS = 512, 500_000, 8192
#: Row numbers that are broadcast at most (16 MB).
BROADCAST = 500_000


def _sets(batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = strings(batch.column(i))
    for a, b in groups(np.diff(offsets)):
        start, end = offsets[a], offsets[b]
        flat, at = shingle_sets(data[start:end], offsets[a:b] - start, offsets[a + 1 : b + 1] - start)
        yield a, b, flat, at


def numbered(docs: DataFrame) -> DataFrame:
    """rid, row (all columns) in the shared folder: a number of its own for each row, the same in every later pass. Passes read the fields they need."""
    return staged(docs.select(F.monotonically_increasing_id().alias("rid"), packed(docs).alias("row")), "rows")


def sketch(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """texts: rid, id, text. Returns rid, id, n, node (16-byte digest of the set), bands; in the shared folder."""
    rows = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, at in _sets(batch, 2):
                n = np.diff(at)
                keys = iter(bands(signatures(flat, at), rows).tolist())
                nodes = [digest(flat[x:y]) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                own = [next(keys) if node else [] for node in nodes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(own, pa.list_(pa.int64()))],
                    names=["rid", "id", "n", "node", "bands"])

    kind = texts.schema["id"].dataType.simpleString()
    return staged(texts.select("rid", "id", "text").mapInArrow(run, f"rid long, id {kind}, n long, node binary, bands array<bigint>"), "sketch")


def full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the rows with these numbers (c_rid), in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, at in _sets(batch, 0):
                some = np.flatnonzero(np.diff(at))
                nodes = [digest(flat[at[k] : at[k + 1]]) for k in some.tolist()]
                sets = pa.ListArray.from_arrays(pa.array(np.append(at[some], at[-1]).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), sets], names=["node", "shingles"])

    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    rows = texts.join(wanted, F.col("rid") == F.col("c_rid"), "left_semi")
    return staged(rows.select("text").mapInArrow(run, "node binary, shingles array<bigint>"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. pairs are distinct and nodes have one set each, so nothing is dealt out by b afterwards and a hot b can be split."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    fits = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    return pairs.join(left, "a").join(right, "b").where(fits & (100 * both >= percent * (F.size("sa") + F.size("sb") - both))).select("a", "b")


def _pairs_within(members: DataFrame) -> DataFrame:
    """All pairs of nodes that share a key."""
    x, y = members.alias("x"), members.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _connected(sets: list[np.ndarray], comps: list, percent: int) -> np.ndarray:
    """For each set the first one that it is connected with, by links between sets of different components. Exact: intersections are products of 0/1 columns."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), n)
    shingle, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)  # others are in no intersection
    column_of = np.full(len(shingle), -1)
    column_of[shared] = np.arange(len(shared))
    at = column_of[place]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        x, y = np.searchsorted(at, (low, low + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, len(shared) - low)), np.float32)
        part[owner[x:y], at[x:y] - low] = 1
        both += part @ part.T
    comp = np.unique(np.array(comps, object).astype(str), return_inverse=True)[1]
    link = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
    label = np.arange(len(sets))
    while True:
        least = np.minimum(label, np.where(link, label[None, :], len(sets)).min(1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _block_links(named: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """named: key, node, n, comp, main (whether comp is the bucket's largest one). Edges that connect what links connect, between components of a bucket.

    A bucket is cut into blocks of about BLOCK nodes and SHINGLES shingles; two blocks meet in a task, unless both are of
    the main component, within which nothing is left to find. A task returns at most an edge per node.
    """
    sizes = named.groupBy("key").agg(*[F.greatest(F.ceil(F.count_if(c) / BLOCK), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / SHINGLES)).cast("int").alias(name) for name, c in (("mains", F.col("main")), ("others", ~F.col("main")))])
    block = F.when(F.col("main"), F.pmod(F.xxhash64("node", F.lit(3)), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node", F.lit(3)), F.greatest("others", F.lit(1)))).cast("int")
    own = named.join(few(staged(sizes, "sizes")), "key").withColumn("block", block)
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    with_main = F.transform(upto("mains"), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("cross")))
    with_others = F.transform(upto("others"), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.lit(False).alias("cross")))
    from_main = F.transform(upto("others"), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("cross")))
    meets = F.explode(F.when(F.col("main"), from_main).otherwise(F.concat(with_main, with_others)))
    rows = own.select("node", "comp", "key", meets.alias("meet")).join(sets, "node").select("key", "meet", "node", "comp", "shingles")

    def verify(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node") if pdf["node"].duplicated().any() else pdf
        nodes = pdf["node"].tolist()
        label = _connected(pdf["shingles"].tolist(), [bytes(c).hex() for c in pdf["comp"]], percent) if len(nodes) > 1 else np.zeros(len(nodes), int)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": [nodes[label[k]] for k in moved], "b": [nodes[k] for k in moved]}, columns=["a", "b"])

    return rows.groupBy("key", "meet").applyInPandas(verify, "a binary, b binary").distinct()


def _named(large: DataFrame, links: DataFrame) -> DataFrame:
    """large with the component that each node is in so far, without buckets of one component; main marks a bucket's largest."""
    if links.isEmpty():
        named = large.withColumn("comp", F.col("node"))
    else:
        comp = components(links).select(F.col("node").alias("c_node"), "comp")
        named = large.join(few(comp), F.col("node") == F.col("c_node"), "left").select(*large.columns, F.coalesce("comp", "node").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    by_key = parts.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("size", "comp")).alias("most")).where("comps > 1")
    by_key = staged(by_key, "by_key")  # dealt out anew for the join, so that adaptive execution can split a hot bucket's partition
    main = (F.col("comp") == F.col("most.comp")) & (F.col("most.size") > 1)
    return staged(named.join(few(by_key), "key").select(*large.columns, "comp", main.alias("main"), (F.col("m") - F.col("most.size")).alias("apart")), "named")


def _large_links(large: DataFrame, sets: DataFrame, links: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (or edges that stand for them) of large buckets (key, node, n, m, rank), beside those known."""
    # Rounds of hubs for buckets of many blocks: a hub is held against the nodes of other components, and then has no link left to find there.
    huge = large.where(F.col("m") > BLOCK)
    for turn in range(ROUNDS):
        if huge.isEmpty():
            break
        named = _named(huge, links)
        named = named.where(F.col("apart") > BLOCK)  # what few nodes are apart meet all others in blocks
        hub = staged(named.groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("rank", "node")).alias("hub")), "hubs")
        held = named.join(few(hub), "key").where(F.col("node") != F.col("hub.node"))
        new = held.where(F.col("comp") != F.col("hub.comp")).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        links = staged(links.union(confirmed(staged(new, "pairs"), sets, percent)).distinct(), "links")
        huge = staged(held.select(*huge.columns), "huge")
    # Hubs are back among the nodes here: their tests are repeated, their components are not.
    return staged(links.union(_block_links(_named(large, links), sets, percent)).distinct(), "links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """rid, id, n, component (smallest id reachable), stays (true for one row of each component). Side tables are deleted."""
    return settled(docs.sparkSession, "near", lambda: _near(numbered(docs), id_col, text_col, percent))


def _near(numbers: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    texts = numbers.select("rid", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).cast("string").alias("text"))
    rows = sketch(texts, percent)
    nodes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "rid")).alias("first"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    nodes = staged(nodes, "nodes")
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("a"), F.max("node").alias("b")).where("m > 1"), "buckets")
    members = staged(keyed.join(buckets.where("m > 2").select("key", "m"), "key"), "members")
    small = buckets.where("m = 2").select("a", "b").union(_pairs_within(members.where(F.col("m") <= SMALL)))
    pairs = staged(small.distinct(), "pairs")
    large = members.where(F.col("m") > SMALL)
    rank = large.groupBy("node").agg(F.sum("m").alias("rank"))
    large = staged(large.join(rank, "node").select("key", "node", "n", "m", "rank"), "large")
    some = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).union(large.select("node")).distinct()
    wanted = staged(nodes.join(some, F.col("node") == F.col("w"), "left_semi").select(F.col("first.rid").alias("c_rid")), "wanted")
    sets = full_sets(texts, wanted)
    links = _large_links(large, sets, staged(confirmed(pairs, sets, percent), "links"), percent)
    if links.isEmpty():
        named = nodes.select("node", "first")
    else:
        # Only nodes that have a link can have another first row than their own.
        comp = components(links).select(F.col("node").alias("c_node"), "comp")
        linked = staged(nodes.join(few(comp), F.col("node") == F.col("c_node")).select("node", "comp", "first"), "linked")
        least = staged(linked.groupBy("comp").agg(F.min("first").alias("least")), "least")
        firsts = staged(linked.select("node", "comp").join(few(least), "comp").select(F.col("node").alias("l_node"), "least"), "firsts")
        named = nodes.join(few(firsts), F.col("node") == F.col("l_node"), "left").select("node", F.coalesce("least", "first").alias("first"))
    named = named.select(F.col("node").alias("n_node"), "first")
    own = F.struct(F.col("id").isNull().alias("null_id"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    out = rows.join(named, F.col("node") == F.col("n_node"), "left").withColumn("first", F.coalesce("first", own))
    return out.select("rid", "id", "n", F.col("first.id").alias("component"), (F.col("rid") == F.col("first.rid")).alias("stays"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the one with the smallest id. Columns stay as they are, and so do all rows that are linked with nothing."""
    numbers = numbered(docs)
    gone = settled(docs.sparkSession, "gone", lambda: _near(numbers, id_col, text_col, percent).where("NOT stays").select(F.col("rid").alias("g_rid")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    kept = numbers.join(gone, F.col("rid") == F.col("g_rid"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
