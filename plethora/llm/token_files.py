"""Token ids as flat binary files: unsigned integers, 64-bit document offsets, read by memory map.

A set of token files is a folder. Each shard of it has three flat little-endian files and a row of the manifest:

    <shard>.tokens    the ids of its documents one after another, uint16 where the vocabulary allows it, else uint32
    <shard>.offsets   uint64: where each document begins among the shard's ids, and where the last one ends
    <shard>.docs      int64: the document ids, without the nulls, which come first
    manifest/         Parquet, a row per shard: names, counts, and first_doc and first_token, the documents and ids of all shards before it

Documents are dealt by ranges of their id, so shards follow each other in its order; a task encodes its range and writes one
shard as it goes, holding a slice of texts at a time. Shards start at 0; their bases are prefix sums over the manifest, a
row per file, so no text or id is moved for them. ``documents`` reads blocks of documents out of memory maps (or ranged reads
where the store is no local mount), ``TokenFiles`` gives a trainer any document or any span of the whole stream.

Encoding is the tokenizers library's. Its pieces never hold white space, and no normal form joins letters across it, so a text's
ids are those of its words (between ASCII white space) one after another. A word is encoded once a worker while it is remembered
(at most ``WORDS`` short ones, about 320 MB), which is several times as fast as encoding each text anew; tests hold this against
whole texts.

Lost executors: a shard's name is unique to the attempt that wrote it, and only the row of the attempt that Spark
accepted is in the manifest; files of other attempts are never read.

Defined results: a null or empty text is the end id alone. Null ids come first; rows of equal ids follow each other by a hash of
their text, then by their place in the table, and all are written. Document ids are whole numbers. Extra columns are ignored,
whatever their names. An empty table gives an empty manifest. A string of a special token inside a text becomes that token,
as the library does by default; ``ordinary=True`` makes it ordinary text.
"""

from __future__ import annotations

import functools
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plethora.llm.common import column, fresh_path, shuffle_parts, table

#: Texts encoded at once, words that a task remembers and the longest of them (bytes), documents of a block that is read at once, ids of a batch that is returned.
SLICE, WORDS, WORD_BYTES, BLOCK, BATCH = 64, 1_600_000, 48, 4096, 1 << 20
#: Words that go to the library in one call, and stops that are pieces of their own.
JOIN, _ENDS = 1000, b".,;:!?"
STOPS = tuple(_ENDS[k : k + 1] for k in range(len(_ENDS)))
END = 1


class WordEncoder:
    """Ids of texts as little-endian bytes, word by word."""

    def __init__(self, definition: str, dtype: str, end: int, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        self.model.encode_special_tokens = ordinary
        self.dtype, self.end = dtype, np.array([end], dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = self._library([b"7"])[0]  # a word of one id that no word without this digit can have

    def _library(self, words: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of words in one call of the library, told apart by the mark between them."""
        if len(words) > 1 and len(self.mark) == len(self.end):
            ids = np.array(self.model.encode_batch_fast([b" 7 ".join(words).decode()], add_special_tokens=False)[0].ids, self.dtype)
            marks = np.flatnonzero(ids == np.frombuffer(self.mark, self.dtype)[0])
            if len(marks) == len(words) - 1:
                size, raw = len(self.mark), ids.tobytes()
                return [raw[a:b] for a, b in zip([0, *((marks + 1) * size).tolist()], [*(marks * size).tolist(), len(raw)])]
        return self._library(words)

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of lower-case ASCII letters, which are whole pieces: the library's merges alone."""
        kind, merge = np.dtype(self.dtype).char, self.model.model.tokenize
        return [array(kind, [token.id for token in merge(word.decode())]).tobytes() for word in words]

    @functools.cached_property
    def alone(self) -> bool:
        """Whether such words pass this file's normalizer and pre-tokenizer as they are."""
        probes = ("a", "z", "word", "abcdefghijklmnopqrstuvwxyz" * 3)
        normal, split = self.model.normalizer, self.model.pre_tokenizer
        return self.lower and sys.byteorder == "little" and all((normal is None or normal.normalize_str(p) == p) and (split is None or [x for x, _ in split.pre_tokenize_str(p)] == [p]) for p in probes) and self._letters([b"word"]) == self._library([b"word"])

    def _learn(self, new: set[bytes]) -> None:
        """Puts words into known. A last stop after an ASCII letter or digit is a piece of its own, and ASCII is lower-cased by the model's file, so that such words share the ids of what is left."""
        known, older, lower, stops = self.known, self.older, self.lower, self.stops
        again = {word: older[word] for word in new if word in older} if older else {}
        known.update(again)
        special, none = b"<" in b" ".join(new), b""  # a special token's string stays as it is
        stems = []
        for word in new.difference(again):
            stem, stop = word.rstrip(_ENDS) if stops else word, none
            if len(stem) != len(word):
                if len(stem) + 1 == len(word) and stem[-1:].isalnum():
                    stop = stops[word[-1:]]
                else:
                    stem = word
            if lower and stem.isascii() and not (special and b"<" in stem):
                stem = stem.lower()
            stems.append((word, stem, stop))
        wanted = {stem for _, stem, _ in stems}.difference(known)
        found = {stem: older[stem] for stem in wanted if stem in older}
        wanted.difference_update(found)
        apart = [w for w in wanted if b"7" in w or b"<" in w]
        found.update(zip(apart, self._library(apart)))
        letters = [w for w in wanted if w.isalpha()] if self.alone else []
        found.update(zip(letters, self._letters(letters)))
        plain = list(wanted.difference(apart).difference(letters))
        for low in range(0, len(plain), JOIN):
            part = plain[low : low + JOIN]
            found.update(zip(part, self._joined(part)))
        known.update(x for x in found.items() if len(x[0]) <= WORD_BYTES)
        known.update([(word, (found.get(stem) or known[stem]) + stop) for word, stem, stop in stems])

    @functools.cached_property
    def lower(self) -> bool:
        return self._library([b"AZ"]) == self._library([b"az"])

    @functools.cached_property
    def stops(self) -> dict[bytes, bytes]:
        """Ids of each stop, if a stop after a letter or digit is a piece of its own in this model; else none."""
        alone = dict(zip(STOPS, self._library(list(STOPS))))
        probes = [b"a", b"Z", b"5", b"word"]
        whole = iter(self._library([p + stop for p in probes for stop in STOPS]))
        return alone if all(next(whole) == p + alone[stop] for p in self._library(probes) for stop in STOPS) else {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(text or "").encode().split() for text in texts]  # bytes split at ASCII white space and nothing else
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(new)
        ids = self.known.__getitem__
        found = [b"".join(map(ids, words)) + self.end for words in split]
        for word in new:
            if len(word) > WORD_BYTES:
                del self.known[word]
        if len(self.known) > WORDS // 2:  # words that are not met again for as long are forgotten
            self.known, self.older = {}, self.known
        return found


_CODERS: dict[tuple, WordEncoder] = {}


def _coder(definition: str, dtype: str, end: int, ordinary: bool) -> WordEncoder:
    """One encoder a worker, for workers serve many tasks."""
    key = (hash(definition), dtype, end, ordinary)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordEncoder(definition, dtype, end, ordinary)
    return _CODERS[key]


def _definition(path: str) -> tuple[str, str]:
    """The tokenizer's file and the width of its ids."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        said = file.read()
    return said, "<u2" if Tokenizer.from_str(said).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, ordinary: bool = False, shards: int | None = None) -> DataFrame:
    """Write token files of docs to the folder path, which executors and driver share; returns the manifest."""
    spark = docs.sparkSession
    said, dtype = _definition(tokenizer)
    if end >= 1 << (8 * np.dtype(dtype).itemsize):
        raise ValueError(f"the end id {end} has no place in {dtype}")
    definition = spark.sparkContext.broadcast(said)  # bounded by the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path)
        coder, shard, out = None, f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", {}
        docs_n = tokens_n = null_n = 0
        try:
            for batch in batches:
                if batch.num_rows and coder is None:
                    coder = _coder(definition.value, dtype, end, ordinary)
                    files.create_dir(folder, recursive=True)
                    out = {kind: files.open_output_stream(f"{folder}/{shard}.{kind}") for kind in ("tokens", "offsets", "docs")}
                    out["offsets"].write(np.zeros(1, "<u8").tobytes())
                for low in range(0, batch.num_rows, SLICE):
                    ids, texts = batch.column(0).slice(low, SLICE), batch.column(1).slice(low, SLICE).to_pylist()
                    coded = coder.encode(texts)
                    ends = tokens_n + np.cumsum([len(x) for x in coded]) // np.dtype(dtype).itemsize
                    out["tokens"].write(b"".join(coded))
                    out["offsets"].write(ends.astype("<u8").tobytes())
                    out["docs"].write(ids.drop_null().to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    docs_n, tokens_n, null_n = docs_n + len(texts), int(ends[-1]), null_n + ids.null_count
        finally:
            for stream in out.values():
                stream.close()
        if docs_n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "shard": shard, "dtype": dtype, "n_docs": docs_n, "n_tokens": tokens_n, "n_null_ids": null_n}])

    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("id"), F.asc("tie"), F.asc("place")]
    dealt = rows.repartitionByRange(shards or shuffle_parts(spark), *order).sortWithinPartitions(*order).select("id", "text")
    written = dealt.mapInArrow(run, "part long, shard string, dtype string, n_docs long, n_tokens long, n_null_ids long")
    written.write.parquet(f"{path}/shards")  # once: from here on the accepted shards are fixed
    kept = spark.read.parquet(f"{path}/shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    kept.withColumns({"first_doc": base("n_docs"), "first_token": base("n_tokens")}).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, shard, dtype, n_docs, n_tokens, n_null_ids, first_doc, first_token: a row per shard."""
    return spark.read.parquet(f"{path}/manifest")


def _view(files: pafs.FileSystem, path: str, dtype: str, low: int, high: int) -> np.ndarray:
    """Elements low to high of a flat file, mapped where the file is local."""
    size = np.dtype(dtype).itemsize
    if high <= low:
        return np.zeros(0, dtype)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", low * size, (high - low,))
    with files.open_input_file(path) as file:
        return np.frombuffer(file.read_at((high - low) * size, low * size), dtype)


def documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_no, doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32), and ids if asked for: a row per document, read back from the files."""
    kinds = {"doc_no": T.LongType(), "doc_id": T.LongType(), "start": T.LongType(), "n_tokens": T.LongType(), "ids_crc32": T.LongType()}
    kinds |= {"ids": T.ArrayType(T.LongType())} if with_ids else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path)
        for block in (row for batch in batches for row in batch.to_pylist()):
            name, low = f"{folder}/{block['shard']}", block["low"]
            high = min(low + BLOCK, block["n_docs"])
            ends = _view(files, f"{name}.offsets", "<u8", low, high + 1).astype(np.int64)
            nulls = max(0, min(block["n_null_ids"], high) - low)
            own = _view(files, f"{name}.docs", "<i8", low + nulls - block["n_null_ids"], high - block["n_null_ids"])
            doc_ids = [None] * nulls + own.tolist()
            first = 0
            while first < high - low:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + BATCH, "right")) - 1)
                tokens = _view(files, f"{name}.tokens", block["dtype"], int(ends[first]), int(ends[last]))
                at = (ends[first : last + 1] - ends[first]).tolist()
                sums = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])]
                columns = [pa.array(range(block["first_doc"] + low + first, block["first_doc"] + low + last), pa.int64()), pa.array(doc_ids[first:last], pa.int64()), pa.array(block["first_token"] + ends[first:last]), pa.array(np.diff(ends[first : last + 1])), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))
                first = last

    blocks = manifest(spark, path).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(BLOCK).cast("long"))))
    return blocks.repartition(shuffle_parts(spark), "shard", "low").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds.items()]))


class TokenFiles:
    """Token files as one stream, for a trainer: any document by its place, any span of ids by its start."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds

        self.files, self.folder = pafs.FileSystem.from_uri(path)
        rows = ds.dataset(f"{self.folder}/manifest", filesystem=self.files, format="parquet").to_table().sort_by("part").to_pylist()
        self.rows, self.first_doc, self.first_token = rows, [r["first_doc"] for r in rows], [r["first_token"] for r in rows]
        self.n_docs, self.n_tokens = (sum(r[c] for r in rows) for c in ("n_docs", "n_tokens"))

    def doc(self, number: int) -> np.ndarray:
        if not 0 <= number < self.n_docs:
            raise IndexError(number)
        row = self.rows[int(np.searchsorted(self.first_doc, number, "right")) - 1]
        low, high = _view(self.files, f"{self.folder}/{row['shard']}.offsets", "<u8", number - row["first_doc"], number - row["first_doc"] + 2).tolist()
        return _view(self.files, f"{self.folder}/{row['shard']}.tokens", row["dtype"], low, high)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the whole stream, across shards; fewer at its end."""
        parts, stop = [], min(start + n, self.n_tokens)
        while start < stop:
            row = self.rows[int(np.searchsorted(self.first_token, start, "right")) - 1]
            high = min(stop, row["first_token"] + row["n_tokens"])
            parts.append(_view(self.files, f"{self.folder}/{row['shard']}.tokens", row["dtype"], start - row["first_token"], high - row["first_token"]))
            start = high
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
