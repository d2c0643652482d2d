"""Document fingerprints: content-defined chunking, with chunk digest sets weighted by length to measure containment.

A fingerprint is the sorted set of a text's chunks (see chunking.py), six bytes each, in base64; equal texts have equal
ones. The likeness of one to another is the share of its chunks' bytes that the other also holds.

``neighbours`` holds each text against an edited form of itself and against the next document in descending id. Texts are
cut into ranges of ids by quantiles and shuffled once, to the partition of their range; there they stream in order, and
only the document before and the batch at hand are in memory. The first document of each range is sent to the range
before it as well, so no partition needs another. What the driver holds is one bound and one id per partition.

Defined results: a null text is empty; null ids come last; rows that tie on the id follow each other by text. A single
row is its own next document. Two empty texts are alike (1.0), an empty and another one are not (0.0). Ids of other types
than whole numbers raise an error. Extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plethora.llm.chunking import chunk_sets, containment
from plethora.llm.common import column, shuffle_parts, table

#: Characters of text that are chunked at once.
TOGETHER = 1 << 20


def packed_set(chunks: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).copy().view(">u8").ravel().astype(np.uint64)


def likeness(fingerprint: str, other: str) -> float:
    return containment(unpacked(fingerprint), unpacked(other))


def fingerprint_column(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with each text's fingerprint added, or replaced where that column exists."""
    others = [c for c in docs.columns if c != out_col]
    frame = docs.select(F.struct(*[column(c) for c in others]).alias("row"), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for some in _groups([(t or "").encode() for t in batch.column(1).to_pylist()]):
                found += map(packed_set, chunk_sets(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["row", "fingerprint"])

    out = frame.mapInArrow(run, frame.select("row", F.lit("").alias("fingerprint")).schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], F.col("fingerprint").alias(out_col))


def _groups(texts: list) -> Iterator[list]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _range_of(bounds: list[int], key: Column) -> Column:
    """How many of the descending bounds are above the key; a key equal to a bound belongs to the range after it. Two short scans instead of one long."""
    step = max(1, int(len(bounds) ** 0.5))
    all_bounds, coarse = F.array(*map(F.lit, bounds)), bounds[step - 1 :: step]
    above = lambda array: F.size(F.filter(array, lambda b: b > key))
    if not bounds:
        return F.lit(0)
    c = above(F.array(*map(F.lit, coarse))) if coarse else F.lit(0)
    return c * step + above(F.slice(all_bounds, c * step + 1, F.lit(step)))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers: documents follow each other by them")
    spark, parts = docs.sparkSession, shuffle_parts(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    found = rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in found}, reverse=True)
    last = len(bounds)
    part = F.when(F.col("id").isNull(), last).otherwise(_range_of(bounds, F.col("id"))).cast("int")
    heads = {r[0]: r[1] for r in rows.select(part.alias("part"), "id").groupBy("part").agg(F.max("id")).collect()}  # a row per partition
    full = sorted(heads)
    if not full:
        full, heads = [0], {0: None}
    before = {p: full[i - 1] for i, p in enumerate(full)}  # the first range's head follows the last range
    head_of = F.array(*[F.lit(heads.get(p)).cast("long") for p in range(last + 1)])
    goes_to = F.array(*[F.lit(before.get(p, 0)) for p in range(last + 1)])
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(goes_to, F.col("part")).alias("part"), F.lit(True).alias("guest"))
    is_head = F.col("id").eqNullSafe(F.get(head_of, F.col("part")))
    sent = (
        rows.withColumn("part", part)
        .select("id", "text", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
        .select(F.col("to.part").alias("part"), F.col("to.guest").alias("guest"), "id", "text")
        .repartitionById(last + 1, "part")
        .sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "text")
    )
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(_compare, schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting: tuple | None = None  # part, guest, id, text, chunks of the row whose next one hasn't come
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at, sizes = 0, [len(t) for t in columns[3]]
        while at < len(sizes):
            end, size = at, 0
            while end < len(sizes) and (end == at or size + sizes[end] <= TOGETHER):
                size += sizes[end]
                end += 1
            rows = list(zip(*[c[at:end] for c in columns]))
            at = end
            sets = chunk_sets([r[3].encode() for r in rows])
            known = ([waiting] if waiting else []) + [(*r, s) for r, s in zip(rows, sets)]
            pairs = [(a, b) for a, b in zip(known, known[1:]) if not a[1] and a[0] == b[0]]  # not from a guest, nor over ranges
            waiting = known[-1]
            edited = []
            for a, b in pairs:
                k = len(a[3]) // 3
                edited.append((a[3][: len(a[3]) - k] + b[3][:k]).encode())
            changed = chunk_sets(edited)
            out = [
                [a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], [hashlib.sha256(e).hexdigest() for e in edited], [packed_set(a[4]) for a, _ in pairs],
                [packed_set(s) for s in changed], [containment(a[4], s) for (a, _), s in zip(pairs, changed)], [containment(a[4], b[4]) for a, b in pairs],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=names)


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
