"""Conversation prefix trie: by partition refinement, which turns many conversations share and what it would save to encode them once.

A node is a distinct sequence of leading turns (role, text); its members are the conversations that begin with it, and the smallest
of them names it. Equal conversations are counted once and carry their number. The rest start as one class. Each round splits the
active classes by the next turn; a class of one sequence retires, and all that follows it is a chain of nodes without branches, put
out in one join at the end. What goes up the tree is folded back in one aggregate: a sequence knows its class at each depth at
which it was active, so its leaf, and the sum over the nodes it names, are added to those classes.

Scale: turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks, and are digests from
there on. A round reads the turns of its depth alone (the table is sorted by depth) and only for sequences that are active, so
all rounds together move each shared turn once; there are as many rounds as turns that two different conversations
share. Classes are joined back as tables of their own, so that a first turn which a third of all conversations share is split.
The digest of a whole sequence is made in blocks of ``FAN`` turns, then of blocks of those. Nothing but counts reaches the driver.
``ends_sha256`` runs over the ids of all equal conversations in order: ranges pack them into pieces of ``PIECE`` ids (about a byte
each), and one task streams the pieces of a sequence that crosses a range. SHA-256 can't be shared out further; no more
than a piece is in memory.

Defined results: null roles and texts are empty, null turns come first, rows that tie on the turn follow by role and text, repeated
rows are turns of their own. Rows without a conversation id belong to none and make no node. Extra columns are ignored, whatever
their names. An empty table gives an empty table. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plethora.llm.common import SPACE, column, few, rounds_of, settled, shuffle_parts, staged, table
from plethora.operators.order_stats import running

#: Digests that are joined into one, and ids in a piece of a digest that crosses a range.
FAN, PIECE = 1024, 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ["node", "depth", "parent", "n_convs", "n_children", "n_leaves", "words", "ends"]


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = False) -> DataFrame:
    """conv, i (from 1), digest, words (and role, text, if asked for): the turns of each conversation in their order, a staged table."""
    role, text = (F.coalesce(column(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(column(conv_col).isNotNull()).select(column(conv_col).cast("long").alias("conv"), column(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # Ranges are told by the starts of role and text, which keeps the sample of range bounds small; equal starts stay together and are sorted whole.
    dealt = rows.repartitionByRange(shuffle_parts(turns.sparkSession), F.asc("conv"), F.asc_nulls_first("turn"), F.substring("role", 1, 16), F.substring("text", 1, 16))
    dealt = dealt.sortWithinPartitions(F.asc("conv"), F.asc_nulls_first("turn"), "role", "text")
    more = ["role", "text"] if texts else []
    placed = staged(dealt.select("conv", digest.alias("digest"), F.regexp_count("text", F.lit(SPACE.replace("[", "[^", 1) + "+")).alias("words"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *more), "turns")
    per = placed.groupBy("conv", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = staged(per.select(F.col("conv").alias("p_conv"), F.col("part").alias("p_part"), (F.col("low") - before).alias("shift")), "bases")
    found = placed.join(per, (F.col("conv") == F.col("p_conv")) & (F.col("part") == F.col("p_part")))
    return staged(found.select("conv", (F.col("at") - F.col("shift") + 1).cast("int").alias("i"), "digest", "words", *more), "own")


def with_shared_heads(own: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv, d, digest, words) and the ids. Each takes its first h turns from the one at its id less id % every."""
    conv = F.col("conv")
    h = (F.crc32(conv.cast("string").cast("binary")) % most).cast("int")
    heads = own.where((conv % every == 0) & (F.col("i") < most)).groupBy(conv.alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "digest", "words"))).alias("head"))
    ids = own.select("conv").distinct().withColumns({"h": h, "base": conv - conv % every})
    none = F.array().cast(heads.schema["head"].dataType)
    ids = staged(ids.join(heads, "base", "left").select("conv", "h", F.filter(F.coalesce("head", none), lambda t: t["i"] <= F.col("h")).alias("head")), "heads")
    first = ids.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.i").alias("d"), "t.digest", "t.words")
    known = ids.select(F.col("conv").alias("c_conv"), "h", F.size("head").alias("b"))
    rest = own.join(known, conv == F.col("c_conv")).where(F.col("i") > F.col("h")).select("conv", (F.col("i") - F.col("h") + F.col("b")).alias("d"), "digest", "words")
    return staged(first.unionByName(rest), "rebuilt"), ids.select("conv")


def sequences(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv, len, seq (digest of all its turns in order; empty without any): a staged table."""
    parts = rows.select("conv", (F.col("d") - 1).alias("at"), F.hex("digest").alias("digest"), F.lit(1).cast("long").alias("n"))
    longest = rows.agg(F.max("d")).first()[0] or 0
    while longest:
        block = F.floor(F.col("at") / FAN).cast("int").alias("at")
        joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), ""), 256)
        parts = parts.groupBy("conv", block).agg(joined.alias("digest"), F.sum("n").alias("n"))
        longest = (longest - 1) // FAN  # the last block's number
    known = parts.select(F.col("conv").alias("s_conv"), F.col("n").cast("int").alias("len"), F.col("digest").alias("seq"))
    return staged(ids.join(known, F.col("conv") == F.col("s_conv"), "left").select("conv", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("seq", F.lit("")).alias("seq")), "sequences")


def _said(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seq, id. A sequence that lies inside of the range is hashed; one at its ends, or a long one, gives pieces."""
    rows: list[dict] = []
    group, held, known, inside = None, [], 0, False

    def piece() -> dict:
        ids = np.concatenate(held)
        return {"seq": group, "low": int(ids[0]), "ids": zlib.compress(np.diff(ids, prepend=0).astype("<i8").tobytes(), 1), "digest": None}

    for batch in batches:
        seqs, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(seqs[1:] != seqs[:-1]) + 1).tolist(), len(seqs)] if len(seqs) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if seqs[a] != group:
                if held:
                    rows.append({"seq": group, "low": None, "ids": None, "digest": hashlib.sha256(_said(np.concatenate(held))).hexdigest()} if inside else piece())
                inside, group, held, known = group is not None, seqs[a], [], 0
            for low in range(a, b, PIECE):
                if known >= PIECE:
                    rows.append(piece())
                    held, known, inside = [], 0, False
                held.append(ids[low : min(b, low + PIECE)])
                known += len(held[-1])
        if len(rows) > 1000:
            yield pa.RecordBatch.from_pylist(rows, _PIECES)
            rows = []
    if held:
        rows.append(piece())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _PIECES)


_PIECES = pa.schema([("seq", pa.string()), ("low", pa.int64()), ("ids", pa.binary()), ("digest", pa.string())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seq, low: one digest per seq, a piece in memory at a time."""
    group, hasher = None, None
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            said = _said(np.cumsum(np.frombuffer(zlib.decompress(row["ids"]), "<i8")))
            if row["seq"] == group:
                hasher.update(b"," + said)
                continue
            if group is not None:
                found.append({"seq": group, "digest": hasher.hexdigest()})
            group, hasher = row["seq"], hashlib.sha256(said)
        if found:
            yield pa.RecordBatch.from_pylist(found)
    if group is not None:
        yield pa.RecordBatch.from_pylist([{"seq": group, "digest": hasher.hexdigest()}])


def member_digests(known: DataFrame) -> DataFrame:
    """seq, digest: of the ids of all conversations that are that sequence, ascending."""
    n = shuffle_parts(known.sparkSession)
    dealt = known.select("seq", "conv").repartitionByRange(n, "seq", "conv").sortWithinPartitions("seq", "conv")
    made = staged(dealt.mapInArrow(_pieces, "seq string, low long, ids binary, digest string"), "pieces")
    crossing = made.where("ids IS NOT NULL").select("seq", "low", "ids").repartition(n, "seq").sortWithinPartitions("seq", "low")
    return staged(made.where("digest IS NOT NULL").select("seq", "digest").unionByName(crossing.mapInArrow(_stream, "seq string, digest string")), "digests")


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations ids (conv) with turns rows (conv, d from 1 without gaps, digest, words)."""
    return settled(rows.sparkSession, "trie", lambda: _trie(rows, ids))


def _trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    spark, n = rows.sparkSession, shuffle_parts(rows.sparkSession)
    known = sequences(rows, ids)
    distinct = staged(known.groupBy("seq", "len").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("w")), "distinct")
    root, total = distinct.agg(F.min("conv"), F.sum("w")).first()
    own = rows.join(distinct.select("conv"), "conv", "left_semi")
    own = staged(own.repartitionByRange(n, "d", "conv").sortWithinPartitions("d", "conv"), "by_depth")  # a round's filter on d skips the rest

    groups, placed = rounds_of(spark, "groups"), rounds_of(spark, "placed")
    active, depth = distinct.where("len > 0").select("conv", "len", "w", F.lit(root).cast("long").alias("class")), 0
    while depth == 0 or not active.isEmpty():
        depth += 1
        turn = own.where(F.col("d") == depth).select(F.col("conv").alias("t_conv"), "digest", "words")
        split = staged(active.join(turn, F.col("conv") == F.col("t_conv")).drop("t_conv"), "split")
        made = groups.write(depth, split.groupBy("class", "digest").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("members"), F.sum("w").alias("n_convs"), F.max("words").alias("words")))
        several = made.where("members > 1").select(F.col("class").alias("g_class"), F.col("digest").alias("g_digest"), "node")
        joined = split.join(few(several), (F.col("class") == F.col("g_class")) & (F.col("digest") == F.col("g_digest")), "left")
        told = placed.write(depth, joined.select("conv", "len", "w", "class", "node"))
        active = told.where((F.col("node").isNotNull()) & (F.col("len") > depth)).select("conv", "len", "w", F.col("node").alias("class"))
    groups, placed = groups.read(), placed.read()

    digests = member_digests(known)
    seq_of = distinct.select(F.col("conv").alias("q_conv"), F.col("len").alias("q_len"), "seq").join(digests, "seq").select("q_conv", "q_len", F.col("digest").alias("ends"))
    retired = staged(placed.where("node IS NULL").join(seq_of, F.col("conv") == F.col("q_conv")).select(F.col("conv").alias("r_conv"), F.col("depth").alias("since"), "class", "w", "len", "ends"), "retired")
    chains = own.join(retired, (F.col("conv") == F.col("r_conv")) & (F.col("d") >= F.col("since"))).select(
        F.col("conv").alias("node"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("since"), F.col("class")).otherwise(F.col("conv")).alias("parent"), F.col("w").alias("n_convs"),
        (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "words", F.when(F.col("d") == F.col("len"), F.col("ends")).otherwise(NO_ENDS).alias("ends"))

    # Nodes that more than one distinct conversation passes: the root and the groups that were split further.
    top = distinct.agg(F.min("conv").alias("node"), F.sum("w").alias("n_convs")).where("node IS NOT NULL").select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).alias("words"))
    branches = top.unionByName(groups.where("members > 1").select("node", "depth", F.col("class").alias("parent"), "n_convs", "words"))
    children = groups.groupBy(F.col("class").alias("c_node"), (F.col("depth") - 1).alias("c_depth")).agg(F.count(F.lit(1)).alias("n_children"))
    ended = placed.where("node IS NOT NULL AND depth = len").select("conv", "node", "depth").unionByName(distinct.where("len = 0").select("conv", F.lit(root).cast("long").alias("node"), F.lit(0).alias("depth")))
    ended = ended.join(seq_of, F.col("conv") == F.col("q_conv")).select(F.col("node").alias("e_node"), F.col("depth").alias("e_depth"), "ends")
    same = lambda node, at: (F.col("node") == F.col(node)) & (F.col("depth") == F.col(at))
    branches = branches.join(children, same("c_node", "c_depth"), "left").join(ended, same("e_node", "e_depth"), "left")
    branches = staged(branches.select("node", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), "words", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends")), "branches")

    # Fold back: what each sequence adds to the classes that it was in while another one named them.
    saved = (F.col("n_convs") - 1) * F.col("words")
    valued = staged(branches.unionByName(chains.where("n_convs > 1")).withColumn("v", saved), "valued")
    sums = valued.groupBy(F.col("node").alias("v_conv")).agg(F.sum("v").alias("own"))
    facts = distinct.select(F.col("conv").alias("f_conv")).join(retired.select(F.col("r_conv"), F.lit(1).alias("leaf")), F.col("f_conv") == F.col("r_conv"), "left").join(sums, F.col("f_conv") == F.col("v_conv"), "left")
    facts = staged(facts.select("f_conv", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("own", F.lit(0)).alias("own")), "facts")
    was_in = placed.where("node IS NOT NULL").select("conv", "node", "depth").unionByName(distinct.select("conv", F.lit(root).cast("long").alias("node"), F.lit(0).alias("depth")))
    folded = was_in.join(facts, F.col("conv") == F.col("f_conv")).groupBy(F.col("node").alias("b_node"), F.col("depth").alias("b_depth")).agg(
        F.sum("leaf").alias("leaves"), F.sum(F.when(F.col("conv") != F.col("node"), F.col("own")).otherwise(0)).alias("others"))
    along = running(valued, ["node"], [F.desc("depth")], "along", "v")  # a chain of any length, from its end
    whole = along.join(folded, same("b_node", "b_depth"), "left").withColumns({
        "n_leaves": F.greatest(F.coalesce("leaves", F.col("n_leaves")), F.lit(1).cast("long")), "saved": F.col("along") + F.coalesce("others", F.lit(0))})
    found = whole.select(*NODE, "saved").unionByName(chains.where("n_convs = 1").select(*NODE, F.lit(0).cast("long").alias("saved")))
    long = lambda c, out: F.col(c).cast("long").alias(out)
    return found.select(long("node", "conv_id"), long("depth", "depth"), long("parent", "parent_conv_id"), long("n_convs", "n_convs"), long("n_children", "n_children"), long("n_leaves", "n_leaves"), long("saved", "saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are: a row per node, named by conv_id (its smallest member) and depth."""
    own = ordered_turns(turns, **columns)
    return trie(own.withColumnRenamed("i", "d"), own.select("conv").distinct())


def node_turns(nodes: DataFrame, turns: DataFrame, **columns: str) -> DataFrame:
    """nodes with role and text of each node's last turn (null at the root)."""
    own = ordered_turns(turns, **columns, texts=True).select(F.col("conv").alias("o_conv"), "i", "role", "text")
    return nodes.join(own, (F.col("conv_id") == F.col("o_conv")) & (F.col("depth") == F.col("i")), "left").select(*nodes.columns, "role", "text")


def query(spark, sf_dir: str) -> DataFrame:
    return trie(*with_shared_heads(ordered_turns(table(spark, sf_dir, "conversations"))))


def _crc(digits: Column | str) -> str:
    """CRC-32 in SQL: the table by its rule, then a fold over the characters of a decimal number."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"


SQL = rf"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS v, 0 AS k FROM generate_series(0, 255) AS g(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(v ORDER BY i) AS crc FROM bits WHERE k = 8),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig,
  len(regexp_extract_all(coalesce(text, ''), '{SPACE.replace("[", "[^", 1)}+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_crc("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM t), crcs),
hd AS (SELECT ids.c, t.i AS d, dig, words FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.i <= h),
b AS (SELECT ids.c, h, count(hd.d) AS b FROM ids LEFT JOIN hd ON hd.c = ids.c GROUP BY ids.c, h),
r AS (SELECT c, d, dig, words FROM hd UNION ALL SELECT t.c, t.i - h + b.b, dig, words FROM t JOIN b ON t.c = b.c WHERE t.i > h),
p AS (SELECT c, 0 AS d, '' AS key, 0 AS words FROM ids UNION ALL SELECT c, d, sha256(string_agg(dig, '') OVER (PARTITION BY c ORDER BY d)), words FROM r),
l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT p.d, p.key, min(p.c) AS rep, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(CASE WHEN l.len = p.d THEN p.c::VARCHAR END, ',' ORDER BY p.c), '')) AS ends FROM p JOIN l ON p.c = l.c GROUP BY p.d, p.key),
e AS (SELECT n.*, u.rep AS parent FROM n LEFT JOIN p ON p.c = n.rep AND p.d = n.d - 1 LEFT JOIN n u ON u.d = p.d AND u.key = p.key),
k AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM e WHERE d > 0 GROUP BY ALL),
f AS (SELECT e.*, coalesce(k.n_children, 0) AS n_children FROM e LEFT JOIN k ON k.rep = e.rep AND k.d = e.d),
s AS (SELECT a.d, a.key, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n - 1) * f.words) AS saved FROM f JOIN p a ON a.c = f.rep AND a.d <= f.d GROUP BY a.d, a.key)
SELECT f.rep AS conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s ON f.d = s.d AND f.key = s.key"""
