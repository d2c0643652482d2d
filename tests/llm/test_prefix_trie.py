"""The prefix trie against a plain one."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plethora.llm import prefix_trie
from tests.conftest import SF


def plain(convs):
    """Rows of the trie of {id: [(role, text), ...]}."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words(node) + sum(saved[k] for k in kids[node])
    ends = lambda node: hashlib.sha256(",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node)))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], ends(node)) for node, m in members.items())


def in_order(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}


def of(nodes):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in nodes.select(*names).collect())


SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    found = []
    for c in range(150):
        for turn in range(r.choice((1, 2, 3, 6))):
            found.append((c, r.choice((turn, turn, turn, None, 0)), r.choice(("user", "user", "assistant", None)), r.choice(("a b", "a b", "c", "", None, "  d\te\nf "))))
    copies = [(c, turn, "user", "the same words again") for c in range(1000, 1100) for turn in range(5)]
    longer = [(1100, turn, "user", "the same words again") for turn in range(7)]
    return found + found[:20] + copies + longer + [(None, 0, "user", "a"), (None, 1, "user", "b"), (-45, 0, "user", "a b")]


def test_trie_against_a_plain_one(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit("x"), "d": F.lit(1), "digest": F.lit(2), "node": F.lit(3)}).repartition(3)
    nodes = prefix_trie.conversation_trie(df)
    want = in_order(rows)
    assert of(nodes) == plain(want)
    told = prefix_trie.node_turns(nodes, df).collect()
    assert all((r["role"], r["text"]) == ((None, None) if r["depth"] == 0 else want[r["conv_id"]][r["depth"] - 1]) for r in told)


def test_shared_heads(spark, rows):
    own, rebuilt = in_order(rows), {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    got = prefix_trie.trie(*prefix_trie.with_shared_heads(prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))))
    assert [] in rebuilt.values() and of(got) == plain(rebuilt)


def test_query_has_a_row_per_node(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = in_order(rows)
    rebuilt = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4 :] for c, t in own.items()}
    assert of(prefix_trie.query(spark, SF)) == plain(rebuilt)


def test_long_conversations_and_copies(spark):
    rows = [(c, t, "user", f"w{t}") for c in (5, 9) for t in range(2 * prefix_trie.FAN + 3)] + [(6, t, "user", f"w{t}" if t < 4 else "x") for t in range(6)]
    assert of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain(in_order(rows))


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert of(prefix_trie.conversation_trie(none)) == [] and of(prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    assert of(prefix_trie.conversation_trie(spark.createDataFrame([(4, None, None, None)], SCHEMA))) == plain({4: [("", "")]})
    rows, ids = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(spark.createDataFrame([(c, 0, "user", "t") for c in range(1, 9) if zlib.crc32(str(c).encode()) % 4], SCHEMA)))
    assert rows.count() == 0 and len(of(prefix_trie.trie(rows, ids))) == 1


def test_digests_that_cross_ranges(monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    r, rows = random.Random(1), []
    for seq, n in (("a", 9), ("b", 1), ("c", 30), ("d", 4), ("e", 5), ("f", 2)):
        rows += [(seq, i) for i in sorted(r.sample(range(-50, 1000), n))]
    done, pieces = {}, []
    for a, b in ((0, 7), (7, 20), (20, 21), (21, 45), (45, len(rows))):
        part = [pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows[x : x + 3]]), pa.array([i for _, i in rows[x : min(x + 3, b)]])][:2], names=["seq", "conv"]) if x + 3 <= b else pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows[x:b]]), pa.array([i for _, i in rows[x:b]])], names=["seq", "conv"]) for x in range(a, b, 3)]
        for batch in prefix_trie._pieces(iter(part)):
            for row in batch.to_pylist():
                if row["digest"]:
                    assert row["seq"] not in done
                    done[row["seq"]] = row["digest"]
                else:
                    pieces.append(row)
    assert all(x["seq"] not in done for x in pieces)
    pieces.sort(key=lambda x: (x["seq"], x["low"]))
    for batch in prefix_trie._stream(iter([pa.RecordBatch.from_pylist([{k: x[k] for k in ("seq", "low", "ids")}]) for x in pieces])):
        done |= {row["seq"]: row["digest"] for row in batch.to_pylist()}
    assert done == {s: hashlib.sha256(",".join(str(i) for t, i in rows if t == s).encode()).hexdigest() for s in "abcdef"}


def test_a_first_turn_of_most_conversations_is_split(spark, skewed):
    rows = [(c, t, "user", "hello" if t == 0 and c % 3 else f"{c} {t}") for c in range(3000) for t in range(2)]
    split = spark.createDataFrame([(r[0], hash(r[3]) % 10**9 if r[1] else (1 if r[0] % 3 else r[0] + 10)) for r in rows if r[1] == 0], "conv long, class long")
    from plethora.llm.common import staged

    left, right = staged(split, "l"), staged(split.groupBy("class").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("class", "g"), "r")
    assert skewed(left.join(right, F.col("class") == F.col("g"), "left")) > 0
    assert of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(in_order(rows))
