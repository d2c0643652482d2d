"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece stores, at each position, the rank of the pair that starts there; its
root names the leftmost pair of minimum rank. Each merge updates the positions of the merged part, of its live neighbour
to the left and of the part swallowed, each in logarithmic time, so a piece of n bytes takes O(n log n), runs of one
letter without any space included.

Pieces of up to ``WORD`` bytes are merged many at a time: numpy holds one tree per row and all rows take a step together
(``merge_batch``); longer pieces have a tree of their own (``merge_piece``).

The split into pieces follows the tokenizer's pattern; equal pieces are merged once while they are in the (bounded)
memory of a worker. Documents stream through Arrow batches, nothing is shuffled, and a lost executor's partitions are
simply encoded again. Very long texts go piece by piece, ``BLOCK`` pieces at a time, so that memory stays bounded.

Defined results: a null text counts as empty and gives no ids. Repeated rows, null ids and ties have no effect on each other; extra
columns pass through, whatever their names, but for one named like the result, which is replaced. Very long texts are encoded in blocks
of pieces. An empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plethora.llm.common import column, table

NONE = 1 << 60
#: Pieces whose ids a worker remembers; code points of text that are split at once; pieces of a very long text handled at once.
REMEMBERED, TOGETHER, BLOCK = 100_000, 1 << 19, 1 << 16
#: Bytes of the longest piece that is merged in a batch; texts whose ids are held at once.
WORD, SLICE = 64, 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    find = ranks.get
    size = 1
    while size < n:
        size *= 2
    tree = [NONE] * (2 * size)  # a node: rank * n + position of the leftmost pair of minimum rank below it
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of live parts, by their first byte
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                break
            tree[node] = least

    def pair(i: int) -> int:
        middle = after[i]
        if middle >= n:
            return NONE
        rank = find(piece[i : after[middle]])
        return NONE if rank is None else rank * n + i

    while tree[1] != NONE:
        i = tree[1] % n
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """The rank of each pair of tokens whose bytes together are a token, by sorted keys."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank, or NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_batch(pieces: list[bytes], size: int, pairs: Pairs) -> list[list[int]]:
    """The ids of each piece; no piece is empty or longer than size, a power of 2. One segment tree per row, one merge a step in each live row."""
    rows, log = len(pieces), size.bit_length() - 1
    n = np.fromiter(map(len, pieces), np.int64, rows)
    part = pairs.bytes[np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(rows, size)]
    place = np.arange(size)
    after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
    live = place < n[:, None]
    tree = np.full((rows, 2 * size), NONE, np.int64)
    rank = pairs(part[:, :-1], part[:, 1:])
    inside = (rank < NONE) & live[:, 1:]
    tree[:, size : 2 * size - 1] = np.where(inside, rank * size + place[:-1], NONE)
    for level in range(log - 1, -1, -1):
        low = 1 << level
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
    at = np.flatnonzero(tree[:, 1] < NONE)
    while len(at):
        best = tree[at, 1]
        i, merged, end = best % size, best // size, n[at]
        gone = after[at, i]
        follow = after[at, gone]
        part[at, i], after[at, i], live[at, gone] = merged, follow, False
        inner = follow < end
        right = np.minimum(follow, size - 1)
        before[at[inner], right[inner]] = i[inner]
        left = before[at, i]
        first = np.maximum(left, 0)
        rank = np.where(inner, pairs(merged, part[at, right]), NONE)
        ahead = np.where(left >= 0, pairs(part[at, first], merged), NONE)
        leaf = np.where(rank < NONE, rank * size + i, NONE)
        tree[at, size + gone], tree[at, size + i] = NONE, leaf
        has = left >= 0
        tree[at[has], size + left[has]] = np.where(ahead < NONE, ahead * size + first, NONE)[has]
        nodes = [size + gone, size + i, size + first]
        for _ in range(log):
            for k in range(3):
                node = nodes[k] = nodes[k] >> 1
                tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
        at = at[tree[at, 1] < NONE]
    ids, ends = part[live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes texts to ids, written in decimal and joined by one space, and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.ids: dict[str, str] = {}  # recently used pieces
        self.older: dict[str, str] = {}  # what was recent before; a piece that is used again moves back
        self.said = [str(rank) for rank in range(max(ranks.values()) + 1)]
        self.bytes = {str(rank): token for token, rank in ranks.items()}
        self.by_id = {rank: token for token, rank in ranks.items()}

    def forget(self) -> None:
        """Between tasks a worker keeps the ranks, not the pieces."""
        self.ids, self.older = {}, {}

    def look_up(self, pieces: list[str]) -> list[str]:
        """The ids of each piece."""
        found = list(map(self.ids.get, pieces))
        if None not in found:
            return found
        new = {piece for piece, ids in zip(pieces, found) if ids is None}
        learned = self._learn(new)
        found = [learned[piece] if ids is None else ids for piece, ids in zip(pieces, found)]
        if len(self.ids) + len(learned) > REMEMBERED:
            self.ids, self.older = {}, self.ids
        self.ids |= {piece: ids for piece, ids in learned.items() if len(piece) <= WORD}
        return found

    def _learn(self, new: set[str]) -> dict[str, str]:
        learned = {piece: self.older[piece] for piece in new & self.older.keys()}
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in new - learned.keys():
            raw = piece.encode("utf-8")
            if len(raw) > WORD:
                learned[piece] = " ".join(map(str, merge_piece(raw, self.ranks)))
            elif raw in self.ranks:
                learned[piece] = self.said[self.ranks[raw]]
            else:
                words, raws = by_size.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), ([], []))
                words.append(piece), raws.append(raw)
        said = self.said
        for size, (words, raws) in by_size.items():
            for at in range(0, len(words), 8192):
                for piece, ids in zip(words[at : at + 8192], merge_batch(raws[at : at + 8192], size, self.pairs)):
                    learned[piece] = " ".join([said[i] for i in ids])
        return learned

    def encode_texts(self, texts: list[str | None]) -> Iterator[Iterator[str]]:
        """For each text its blocks of ids; a text's blocks are to be used before the next text."""
        waiting, size = [], 0
        for text in texts:
            text = text or ""
            if size + len(text) > TOGETHER:
                yield from self._together(waiting)
                waiting, size = [], 0
            if len(text) > TOGETHER:
                yield self._long(text)
            else:
                waiting.append(text)
                size += len(text)
        yield from self._together(waiting)

    def _together(self, texts: list[str]) -> Iterator[Iterator[str]]:
        split = [self.pattern.findall(text) for text in texts]
        ids, at = self.look_up([piece for pieces in split for piece in pieces]), 0
        for pieces in split:
            yield iter([" ".join(ids[at : at + len(pieces)])] if pieces else [])
            at += len(pieces)

    def _long(self, text: str) -> Iterator[str]:
        found = (m.group() for m in self.pattern.finditer(text))
        while pieces := list(islice(found, BLOCK)):
            yield " ".join(self.look_up(pieces))

    def encode(self, text: str) -> list[int]:
        return [int(x) for blocks in self.encode_texts([text]) for block in blocks for x in block.split(" ")]

    def decode_block(self, block: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, block.split(" ")))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    """One codec a worker, for workers serve many tasks."""
    key = (hash(lines), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}, pattern)
    return _CODECS[key]


def _numbers(blocks: Iterator[str]) -> np.ndarray:
    """Ids in decimal as int32; four bytes a token, where a list of Python's numbers would take ten times that."""
    return np.concatenate([np.zeros(0, np.int32), *[np.fromstring(block, np.int32, sep=" ") for block in blocks]])


def _rank_file(spark, path: str):
    """The rank file's bytes as a broadcast: bounded by the vocabulary (50,256 tokens, under 1 MB), whatever the corpus."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", verify: bool = False) -> DataFrame:
    """docs with a column of ids (array of int) added, or replaced where it exists. verify: decode each text's ids and fail where they don't give the text back."""
    lines = _rank_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, pattern)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, SLICE):
                plain = texts.slice(low, SLICE).to_pylist()
                found = [_numbers(blocks) for blocks in codec.encode_texts(plain)]
                if verify:
                    for text, ids in zip(plain, found):
                        if codec.decode(ids.tolist()) != (text or "").encode():
                            raise ValueError(f"the ids of a text of {len(text or '')} characters don't decode to it")
                offsets = np.append(0, np.cumsum(list(map(len, found)))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([rows.slice(low, SLICE), ids], names=["row", "ids"])
        codec.forget()

    others = [c for c in docs.columns if c != ids_col]
    frame = docs.select(F.struct(*[column(c) for c in others]).alias("row"), column(text_col).alias("text"))
    schema = T.StructType([frame.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = frame.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], F.col("ids").alias(ids_col))


def decode_column(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids added, or replaced where that column exists. Null ids give null; bytes that are no UTF-8 become U+FFFD."""
    lines = _rank_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                texts = [None if ids is None else codec.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).slice(low, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, SLICE), pa.array(texts, pa.string())], names=["row", "text"])

    others = [c for c in docs.columns if c != text_col]
    frame = docs.select(F.struct(*[column(c) for c in others]).alias("row"), column(ids_col).cast("array<int>").alias("ids"))
    out = frame.mapInArrow(run, T.StructType([frame.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], F.col("text").alias(text_col))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, exact (whether the decoded bytes are the text's): a round trip of every whole text."""
    lines = _rank_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, pattern)
        for batch in batches:
            n, said, back, same = [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, blocks in zip(texts, codec.encode_texts(texts)):
                count, ids, decoded, plain = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256((text or "").encode())
                for block in blocks:
                    ids.update((" " + block if count else block).encode())
                    count += block.count(" ") + 1
                    decoded.update(codec.decode_block(block))
                n.append(count), said.append(ids.hexdigest()), back.append(decoded.hexdigest()), same.append(decoded.digest() == plain.digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])
        codec.forget()

    frame = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
