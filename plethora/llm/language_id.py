"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy, with calibrated rejection.

The model is fitted in the driver on a bounded sample of labelled rows, chosen by hash: at most ``PER_LANG`` documents of a
language, and of many languages fewer, so that all together are about ``TOGETHER`` (``FEW`` of each at least). Of a longer text
``WINDOWS`` windows of together ``TRAIN_CHARS`` code points are read, one at a hashed place in each of as many equal parts of the
whole text. One fifth of each language's rows (of five at least) is held back to set the softmax temperature and two
rejection thresholds: documents are rejected whose calibrated score, or whose share of known 4-grams, is below a part
(``SLACK``) of the ``REJECT`` quantile of the held-back ones that were predicted rightly. Known are the 4-grams of the learned
rows; those with digits don't count. The share doesn't rest on the softmax, so it also tells a text in no learned language,
however sure the softmax is. Without held-back rows nothing is calibrated.

Prediction reads every whole text, in Arrow batches and in pieces of a bounded size, without any shuffle. The broadcast model
is 2^bits rows of a float per language or per embedding dimension, whichever is less, and a row of that length per language.

Scale: a language's rows are narrowed by a bound on their hash that follows from their number before they are ranked, so the
ranking sees about twice the sample, whatever the corpus; repeated rows are counted once and are one row a task. The driver holds the sample's
code points and the n-grams of one training batch at a time.

Defined results: a null text or one without any letter is ``und`` with score 0 and rejected. Without any labelled row
every document is ``und``. Ties go to the first language by name. Rows with equal id, text and language are learned from once.
Repeated rows, null ids and extra columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plethora.llm.common import column, packed, staged, table
from plethora.llm.subword import BagModel, fold, grams, pieces, softmax, strings

ORDERS, BITS, DIM = (1, 2, 3, 4), 15, 16
PER_LANG, TOGETHER, FEW = 600, 24_000, 10
TRAIN_CHARS, WINDOWS = 3000, 30
#: Rows of the sample whose keys are broadcast at most.
BROADCAST = 500_000
#: Quantile of the held-back rows, and the part of it that is the threshold, of the score and of the share: the lowest of few rows isn't the lowest of all, and a text in two learned languages has half a score at times.
REJECT, SLACK = 0.0005, (0.6, 0.8)
#: The n-grams that are looked up among those of the learned rows, and the bits of their table.
SEEN, SEEN_BITS = 4, 20
#: Passes over the learned rows, and steps that are made at least.
EPOCHS, BATCH, STEPS = 4, 32, 240


def _places(folded: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket at each place; n-grams that would cross the end of a text have the empty bucket."""
    for n, bucket in grams(folded, ORDERS, BITS):
        for back in range(1, n):
            at = ends - back
            bucket[at[at >= 0]] = 1 << BITS
        yield bucket


def _looked_up(folded: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the SEEN-gram at each place, and whether it lies within its text and holds no digit (numbers tell nothing of a language)."""
    bucket = next(grams(folded, (SEEN,), SEEN_BITS))[1]
    size = np.maximum(ends - first - SEEN + 1, 0)
    inside = np.arange(len(folded)) < np.repeat(first + size, ends - first)
    digit = np.flatnonzero((folded >= ord("0")) & (folded <= ord("9")))
    for back in range(SEEN):
        inside[digit[digit >= back] - back] = False
    return bucket, inside


class Model:
    """languages, rows (by bucket: a float per language, or an embedding that out maps to languages), bias, temperature, threshold, seen (bit of each SEEN-gram), least (share of seen ones): what executors need."""

    def __init__(self, languages: list[str], rows: np.ndarray, out: np.ndarray | None, bias: np.ndarray, seen: np.ndarray):
        self.languages, self.rows, self.out, self.bias, self.seen = languages, rows, out, bias, seen
        self.temperature, self.threshold, self.least = 1.0, 0.0, 0.0

    def familiar(self, texts: pa.Array) -> np.ndarray:
        """The share of each whole text's SEEN-grams that the learned rows hold; 1 without any."""
        data, offsets = strings(texts)
        held, count = np.zeros(len(texts)), np.zeros(len(texts))
        for start, end, first, which in pieces(offsets):
            first = first - start
            bucket, inside = _looked_up(fold(data[start:end]), first, np.append(first[1:], end - start))
            np.add.at(held, which, np.add.reduceat((self.seen[bucket] & inside).astype(np.int64), first))
            np.add.at(count, which, np.add.reduceat(inside.astype(np.int64), first))
        return np.where(count > 0, held / np.maximum(count, 1), 1.0)

    def rejects(self, texts: pa.Array, score: np.ndarray) -> np.ndarray:
        return (score < self.threshold) | (self.familiar(texts) < self.least)

    def logits(self, texts: pa.Array) -> np.ndarray:
        """A row per whole text, a column per language."""
        data, offsets = strings(texts)
        total, count = np.zeros((len(texts), self.rows.shape[1])), np.zeros(len(texts))
        for start, end, first, which in pieces(offsets):
            folded = fold(data[start:end])
            summed, known = np.zeros((end - start, self.rows.shape[1]), np.float32), np.zeros(end - start, np.float32)
            for bucket in _places(folded, np.append(first[1:], end) - start):
                summed += self.rows[bucket]
                known += bucket < 1 << BITS
            np.add.at(total, which, np.add.reduceat(summed, first - start, dtype=np.float64))
            np.add.at(count, which, np.add.reduceat(known, first - start, dtype=np.float64))
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.out is None else mean @ self.out) + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and calibrated score of each text."""
        p = softmax(self.logits(texts) / self.temperature)
        return p.argmax(1), p.max(1)


def train(texts: list[str], labels: list[str]) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    raw = [fold(np.frombuffer((t or " ").encode("utf-8"), np.uint8)) for t in texts]
    y = np.searchsorted(languages, labels)
    held = np.zeros(len(texts), bool)
    for k in range(len(languages)):  # each language keeps four rows of five to learn from
        held[np.flatnonzero(y == k)[4::5]] = True
    learn = np.flatnonzero(~held)

    # Each learned text once as its buckets and how often it holds them.
    bags, times = [], []
    for i in learn.tolist():
        found = np.zeros((1 << BITS) + 1, np.int64)
        for bucket in _places(raw[i], np.array([len(raw[i])])):
            found += np.bincount(bucket, minlength=len(found))
        found[-1] = 0  # places that hold no n-gram
        bags.append(np.flatnonzero(found).astype(np.uint16))
        times.append(found[bags[-1]].astype(np.float32))
    ids, often, size = np.concatenate(bags), np.concatenate(times), np.array(list(map(len, bags)))
    first = np.cumsum(size) - size
    del bags, times

    def counts(rows: np.ndarray) -> np.ndarray:
        own = size[rows]
        at = np.repeat(first[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())
        held = np.zeros((len(rows), (1 << BITS) + 1), np.float32)
        held[np.repeat(np.arange(len(rows)), own), ids[at]] = often[at]
        return held

    model = BagModel(len(languages), BITS, DIM)
    share = np.bincount(y[learn], minlength=len(languages))
    passes = max(EPOCHS, -(-STEPS * BATCH // len(learn)))
    model.fit_counts(counts, y[learn], (1 / np.maximum(share, 1))[y[learn]].astype(np.float32), passes, BATCH)
    seen = np.zeros(1 << SEEN_BITS, bool)
    for i in learn.tolist():
        bucket, inside = _looked_up(raw[i], np.array([0]), np.array([len(raw[i])]))
        seen[bucket[inside]] = True
    wide = len(languages) > DIM
    found = Model(languages, model.embedding if wide else model.table(), model.weights if wide else None, model.bias, seen)
    if held.any():
        kept, right = pa.array([texts[i] for i in np.flatnonzero(held).tolist()], pa.string()), y[held]
        score = found.logits(kept)
        loss = lambda t: -np.log(softmax(score / t)[np.arange(len(right)), right] + 1e-12).mean()
        found.temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = softmax(score / found.temperature)
        good = p.argmax(1) == right
        if good.any():
            found.threshold, found.least = (float(part * np.quantile(x[good], REJECT)) for part, x in zip(SLACK, (p.max(1), found.familiar(kept))))
    return found


def windows(text: Column, key: Column) -> Column:
    """The text, or windows over the whole of a longer one."""
    size, n = TRAIN_CHARS // WINDOWS, F.char_length(text)
    part = n / F.lit(float(WINDOWS))
    place = lambda k: F.pmod(F.xxhash64(key, k), F.lit(1 << 20)) / float(1 << 20)
    at = lambda k: F.floor(k * part + place(k) * (part - size)).cast("int") + 1
    some = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring(text, at(k), F.lit(size)))
    return F.when(n <= TRAIN_CHARS, text).otherwise(F.array_join(some, " "))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, allowed: Column) -> tuple[list[str], list[str]]:
    """The training texts and their languages, in the order of a hash of id and text. Keys alone are ranked; their texts are fetched after that."""
    text, lang = column(text_col).cast("string"), column(lang_col).cast("string")
    known = docs.where(allowed & lang.isNotNull() & text.isNotNull()).select(text.alias("t"), lang.alias("l"), F.xxhash64(column(id_col).cast("string"), text, F.lit(11)).alias("key"))
    counts = staged(known.groupBy("l").agg(F.approx_count_distinct("key").alias("n")), "languages")
    languages = counts.count()
    quota = max(FEW, min(PER_LANG, TOGETHER // max(1, languages)))
    place = F.shiftrightunsigned("key", 11) / float(1 << 53)
    near = known.select("l", "key").join(F.broadcast(counts) if languages <= BROADCAST else counts, "l").where(place * F.col("n") <= 2 * quota + 50)
    rank = F.row_number().over(Window.partitionBy("l").orderBy("key"))
    chosen = staged(near.select("l", "key").distinct().withColumn("rank", rank).where(F.col("rank") <= quota).select("l", "key"), "chosen")
    rows = known.join(F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen, ["l", "key"], "left_semi")
    found = sorted(map(tuple, rows.select("key", "l", windows(F.col("t"), F.col("key")).alias("t")).groupBy("key", "l").agg(F.first("t").alias("t")).collect()))
    return [t for _, _, t in found], [l for _, l, _ in found]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", allowed: Column | None = None) -> Model | None:
    return train(*sample(docs, id_col, text_col, lang_col, F.lit(True) if allowed is None else allowed))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """row (all columns but the text), text (if it is kept), lang_pred, score, rejected. A text goes to Python once, and back only if it is kept."""
    letter = F.coalesce(column(text_col).rlike(r"\p{L}"), F.lit(False))
    frame = docs.select(packed(docs, text_col).alias("row"), column(text_col).alias("text"), letter.alias("letter"))
    kept = ["row", "text"] if keep_text else ["row"]
    if model is None:
        return frame.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            best, score = model.predict(batch.column(1))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.where(letter, best, len(names) - 1), np.where(letter, score, 0.0)
            found = [pa.array(names[best], pa.string()), pa.array(score), pa.array(~letter | model.rejects(batch.column(1), score))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], names=[*kept, "lang_pred", "score", "rejected"])

    schema = frame.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return frame.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects."""
    kept = predict(docs, model, text_col).where(~F.col("rejected"))
    return kept.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs, allowed=~held_out)
    return predict(docs.select("doc_id", "text"), model, keep_text=False).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "rejected").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
