"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A bag is a run of ``WORDS`` words of a text; its subwords are the byte n-grams within each word and its borders, so an
unseen misspelling shares most vectors with the word it comes from. Labels are known per document only: the first pass
gives every run its document's label, each further pass keeps of a toxic document the runs that now score highest.
A document's score is a logistic function, fitted on the same rows, of its highest run, so one toxic run is enough in a text
of any length.

The model is fitted in the driver on a bounded sample of labelled rows, chosen by hash: at most ``HARMLESS`` and ``TOXIC``
documents of the two labels, each of them whole, as its label is of the whole text. Scoring reads every whole text, in Arrow batches and pieces of
bounded size, without any shuffle; the broadcast model is one float for each of 2^bits buckets.

Defined results: null, empty and wordless texts have no run and get the score of a text whose runs are all harmless.
Without a labelled row of both labels every score is the share of toxic labels (0 without any). Null labels are ignored; of
a document labelled more than once the highest label counts; a labelled id's texts are all learned from, equal ones once (of
ids that hold more than twice the sample's texts the first by hash). Repeated rows, null ids and extra columns pass through,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plethora.llm.common import column, packed, staged, table
from plethora.llm.subword import BagModel, fold, grams, pieces, strings

WORDS, ORDERS, BITS, DIM = 3, (3, 4, 5, 6), 17, 6
HARMLESS, TOXIC = 2000, 1000
#: Bags that are scored at once while training.
SCORED = 20_000
PASSES, EPOCHS, BATCH = 3, 2, 4096
#: Runs that a toxic document keeps after a pass, and the score from which a document is predicted toxic.
TOP_RUNS, THRESHOLD = 2, 0.3
SPACE = 32


def runs(folded: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of words in the bytes, and the piece (index into first) of each. first: where the pieces start."""
    space = folded == SPACE
    before = np.empty_like(space)
    before[1:], before[0] = space[:-1], True
    before[first] = True
    words = np.flatnonzero(~space & before)
    piece = np.searchsorted(first, words, "right") - 1
    number = np.arange(len(words)) - np.searchsorted(words, first)[piece]
    head = number % WORDS == 0
    starts = words[head]
    border = (starts > first[piece[head]])  # the space before the first word belongs to the run
    return starts - border, piece[head]


def buckets(folded: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket at each place; n-grams over more than one word or text have the empty bucket."""
    spaces = np.concatenate([[0], np.cumsum(folded == SPACE, dtype=np.int32)])
    ends = np.append(first[1:], len(folded))
    n_bytes = len(folded)
    for n, bucket in grams(folded, ORDERS, BITS):
        inner = np.minimum(np.arange(n_bytes) + 1, n_bytes)
        outer = np.minimum(np.arange(n_bytes) + n - 1, n_bytes)
        bucket[spaces[outer] != spaces[inner]] = 1 << BITS
        for back in range(1, n):
            at = ends - back
            bucket[at[at >= 0]] = 1 << BITS
        yield bucket


class Model:
    """rows (a logit per bucket), bias, and the document's logistic weights: what executors need."""

    def __init__(self, rows: np.ndarray, bias: float, doc: np.ndarray):
        self.rows, self.bias, self.doc = rows, bias, doc

    def features(self, texts: pa.Array) -> np.ndarray:
        """The logit of the highest run, within bounds."""
        data, offsets = strings(texts)
        n = len(texts)
        top = np.full(n, -6.0)
        for start, end, first, which in pieces(offsets):
            first = first - start
            folded = fold(data[start:end])
            starts, piece = runs(folded, first)
            if not len(starts):
                continue
            total, count = np.zeros(end - start, np.float32), np.zeros(end - start, np.int32)
            for bucket in buckets(folded, first):
                total += self.rows[bucket]
                count += bucket < 1 << BITS
            # n-grams after a piece's last run and before its first belong to no other piece, for they are empty there
            logit = np.add.reduceat(total, starts) / np.maximum(np.add.reduceat(count, starts), 1) + self.bias
            np.maximum.at(top, which[piece], np.clip(logit, -6, 6))
        return top[:, None]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.rows is None:
            return np.full(len(texts), self.bias)
        x = self.features(texts) @ self.doc[:-1] + self.doc[-1]
        return 1 / (1 + np.exp(-x))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and intercept of a slightly regularised logistic regression, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.1 * w)
    return w


def train(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """share: of toxic labels among all rows, where texts over-represent one label."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(None, float(y.mean()) if len(y) else 0.0, None)
    share = float(y.mean()) if share is None else share
    parts, begins, lengths, owners, at = [], [], [], [], 0
    for k, t in enumerate(texts):  # one text at a time; memory holds the texts' bytes, and n-grams are made for a batch at a time
        folded, first = fold(np.frombuffer(t.encode("utf-8"), np.uint8)), np.zeros(1, np.int64)
        starts, _ = runs(folded, first) if len(folded) else (np.zeros(0, np.int64), None)
        if not len(starts):
            continue
        used = sum((bucket < 1 << BITS).astype(np.int64) for bucket in buckets(folded, first))
        some = np.add.reduceat(used, starts) > 0
        reach = np.minimum(np.append(starts[1:], len(folded)) + 1, len(folded))  # with the space that ends the last word
        parts.append(folded), begins.append(at + starts[some]), lengths.append((reach - starts)[some]), owners.append(np.full(some.sum(), k))
        at += len(folded)
    if not parts or not sum(map(len, owners)):
        return Model(None, share, None)
    data, begin, length, text = np.concatenate(parts), np.concatenate(begins), np.concatenate(lengths), np.concatenate(owners)
    del parts

    def take(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of these runs, one run after another, and their numbers."""
        size = length[rows]
        first = np.cumsum(size) - size
        found = np.stack(list(buckets(data[np.repeat(begin[rows] - first, size) + np.arange(size.sum())], first)), 1)
        used = found < 1 << BITS
        return found[used], np.add.reduceat(used.sum(1), first)

    target = y[text]
    chosen = np.arange(len(begin))
    model = BagModel(2, BITS, DIM)
    for _ in range(PASSES):
        counts = np.bincount(target[chosen], minlength=2)
        weight = (1 / np.maximum(counts, 1))[target[chosen]]
        weight[target[chosen] == 0] *= 3
        model.fit_bags(lambda rows, own=chosen: take(own[rows]), target[chosen], weight.astype(np.float32), EPOCHS, BATCH)
        logit = np.empty(len(begin), np.float32)
        for low in range(0, len(begin), SCORED):
            high = min(low + SCORED, len(begin))
            ids, size = take(np.arange(low, high))
            score = model.scores(ids, np.cumsum(size) - size)
            logit[low:high] = score[:, 1] - score[:, 0]
        rank = np.lexsort((-logit, text))
        new = np.append(True, text[rank][1:] != text[rank][:-1])
        place = np.arange(len(rank)) - np.maximum.accumulate(np.where(new, np.arange(len(rank)), 0))
        top = rank[(place < TOP_RUNS) & (target[rank] == 1)]
        chosen = np.concatenate([np.flatnonzero(target == 0), top])
    rows = model.table()
    found = Model(rows[:, 1] - rows[:, 0], float(model.bias[1] - model.bias[0]), None)
    found.rows[-1] = 0
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    found.doc = _logistic(found.features(pa.array(texts, pa.string())), y, weight)
    return found


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: Column) -> tuple[list[str], list[int], float | None]:
    """The training rows and the share of toxic labels. Ids alone are ranked, those whose hash is below a bound that follows from the label's count; texts are fetched by a broadcast of at most HARMLESS + TOXIC ids."""
    known = labels.where(allowed & column(label_col).isNotNull() & column(id_col).isNotNull()).groupBy(column(id_col).alias("c_id")).agg((F.max(column(label_col)) > 0).cast("int").alias("c_label"))
    known = staged(known.withColumn("key", F.xxhash64(F.col("c_id").cast("string"), F.lit(13))), "labels")
    counts = {r[0]: r[1] for r in known.groupBy("c_label").count().collect()}  # two rows at most
    place = F.shiftrightunsigned("key", 11) / float(1 << 53)
    pick = lambda label, most: known.where((F.col("c_label") == label) & (place * counts.get(label, 0) <= 2 * most + 50)).orderBy("key", "c_id").limit(most)
    chosen = pick(0, HARMLESS).union(pick(1, TOXIC))
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("c_id")).withColumn("hash", F.xxhash64("t"))
    rows = rows.groupBy("key", "c_id", "hash").agg(F.first("t").alias("t"), F.first("c_label").alias("c_label"))  # repeated rows are one row a task
    found = sorted((r["c_id"], r["t"], r["c_label"]) for r in rows.orderBy("key", "c_id", "hash").limit(2 * (HARMLESS + TOXIC)).collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [t for _, t, _ in found], [l for _, _, l in found], share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", allowed: Column | None = None) -> Model:
    return train(*sample(docs, labels, id_col, text_col, label_col, F.lit(True) if allowed is None else allowed))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (all columns), score, predicted."""
    frame = docs.select(packed(docs).alias("row"), column(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["row", "score", "predicted"])

    return frame.mapInArrow(run, frame.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, labels, allowed=~held_out)
    return score(docs, model).select(F.col("row.doc_id").alias("doc_id"), "score", "predicted").select("doc_id", held_out.alias("held_out"), "score", "predicted")
