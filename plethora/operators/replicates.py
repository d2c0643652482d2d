"""Many replicates over the same rows at once: bootstrap medians, leave-one-out quantiles, risk-coverage areas, rank correlations.

A replicate (or fold, or coverage of a replicate) is a column: it says how often each row counts. Rows are never repeated or
joined with replicates. They are dealt by ranges of the value; counts per range and class of rows (its subject, say), times the weights
of that class in each column, give every column's weight per range in one matrix product. Cumulated over ranges they tell in which
range a column's order statistic lies and how far into it; only those ranges are sorted, and a range that is too large is dealt
again among its own values. What grows with replicates is columns times ranges, in blocks of ``BLOCK`` columns; what grows
with the data is one shuffle of the values.

Ranks are prefix count vectors: how many rows of each subject lie below a value. A replicate's rank is the product with its
weights, so a rank correlation needs one vector of subjects per distinct value instead of a rank per row and replicate.
Where the rows themselves depend on the replicate (the best half of its ranking), ranks are vectors over replicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plethora.operators.joins import small, values
from plethora.operators.order_stats import _same, by_range
from plethora.sources.shared import stage

#: Columns of one matrix block, entries of a block of rows times columns, rows of a range that is sorted at once.
BLOCK, CELLS, MOST = 1024, 1 << 21, 1 << 19


@dataclass(frozen=True)
class Weights:
    """columns: how many. of(rows, low, high): rows x columns low..high, how often a row counts there. classes: the columns of the rows that decide this (none: every row by itself)."""

    columns: int
    of: Callable[[pd.DataFrame, int, int], np.ndarray]
    classes: list[str] = field(default_factory=list)
    #: tally(rows, weights, low, high): sums over rows, where there is a shorter way than the product.
    tally: Callable[[pd.DataFrame, np.ndarray, int, int], np.ndarray] | None = None

    def sums(self, rows: pd.DataFrame, low: int, high: int) -> np.ndarray:
        w = rows["_w"].to_numpy(np.float64)
        if self.tally:
            return self.tally(rows, w, low, high)
        step, total = max(1, CELLS // (high - low)), np.zeros(high - low)
        for at in range(0, len(rows), step):
            total += w[at : at + step] @ self.of(rows.iloc[at : at + step], low, high)
        return total


def places(values: list, of: pd.Series) -> np.ndarray:
    """The number of each value; that of an unknown one is len(values)."""
    found = pd.Index(values).get_indexer(of)
    return np.where(found < 0, len(values), found)


def drawn(matrix: np.ndarray, subjects: list, subject: str) -> Weights:
    """matrix: subjects x replicates, how often each was drawn. Subjects that aren't listed count nowhere."""
    wide = np.vstack([matrix, np.zeros((1, matrix.shape[1]), matrix.dtype)])
    return Weights(matrix.shape[1], lambda rows, low, high: wide[places(subjects, rows[subject]), low:high].astype(np.float64), [subject])


def left_out(subjects: list, subject: str) -> Weights:
    """Column k: all rows but those of subject k. Sums are those of all rows less the subject's own."""

    def of(rows: pd.DataFrame, low: int, high: int) -> np.ndarray:
        return (places(subjects, rows[subject])[:, None] != np.arange(low, high)[None, :]).astype(np.float64)

    def tally(rows: pd.DataFrame, w: np.ndarray, low: int, high: int) -> np.ndarray:
        own = np.bincount(places(subjects, rows[subject]), w, len(subjects) + 1)
        return w.sum() - own[low:high]

    return Weights(len(subjects), of, [subject], tally)


def _types(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _tallies(rows: DataFrame, keys: list[str], weights: Weights) -> DataFrame:
    """keys, _part, _block, sums: the weight of each range in a block of columns; several rows of one may add up."""
    own = ["_part", *keys]
    classes = rows.groupBy(*own, *weights.classes).agg(F.sum("_w").alias("_w")) if weights.classes else rows
    blocks = [(b, low, min(low + BLOCK, weights.columns)) for b, low in enumerate(range(0, weights.columns, BLOCK))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, group in batch.groupby(own, dropna=False, sort=False):
                said = (str(key), group.iloc[:1][own])
                for b, low, high in blocks:
                    was = held.get((said[0], b))
                    made = weights.sums(group, low, high)
                    held[(said[0], b)] = (said[1], made if was is None else was[1] + made)
            if len(held) > 256:
                yield from told(held)
                held = {}
        yield from told(held)

    def told(held: dict) -> Iterator[pd.DataFrame]:
        if held:
            yield pd.concat([head.assign(_block=b, sums=[sums.tobytes()]) for (_, b), (head, sums) in held.items()])[[*own, "_block", "sums"]]

    return stage(classes.mapInPandas(run, f"{_types(rows, own)}_block int, sums binary"), "tallies")


def _matrix(tall: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order, and their sums, ranges x columns."""
    parts, at = np.unique(tall["_part"].to_numpy(), return_inverse=True)
    sums = np.zeros((len(parts), len(tall["sums"].iloc[0]) // 8 if len(tall) else 0))
    for k, s in zip(at.tolist(), tall["sums"]):
        sums[k] += np.frombuffer(s)
    return parts, sums


_WANTED = "_block int, column int, name string, share double, n double, _part int, at double"


def _ends(n: np.ndarray, positions: dict[str, np.ndarray], low: int) -> pd.DataFrame:
    """Two rows at most per column and name: whole positions and their shares; a missing position gives one without a place."""
    found = []
    for name, p in positions.items():
        whole = np.floor(p)
        for at, share in ((whole, 1 - (p - whole)), (whole + 1, p - whole)):
            use = share > 0
            found.append(pd.DataFrame({"column": low + np.flatnonzero(use), "name": name, "share": share[use], "n": n[use], "at": at[use]}))
        gone = ~(p >= 0)
        found.append(pd.DataFrame({"column": low + np.flatnonzero(gone), "name": name, "share": 0.0, "n": n[gone], "at": np.nan}))
    return pd.concat(found)


def _found(parts: np.ndarray, sums: np.ndarray, want: pd.DataFrame, low: int) -> pd.DataFrame:
    """The range of each wanted place, and the place in it."""
    cum = np.vstack([np.zeros(sums.shape[1]), np.cumsum(sums, 0)])
    column, at = want["column"].to_numpy() - low, want["at"].to_numpy()
    part = np.array([np.searchsorted(cum[1:, c], a, "right") if a == a else -1 for c, a in zip(column.tolist(), at.tolist())], int)
    known = part >= 0
    inside = np.where(known, at - cum[np.maximum(part, 0), column], np.nan)
    return want.assign(_part=pd.array(np.where(known, parts[np.maximum(part, 0)] if len(parts) else -1, -1), "Int32").astype("int32"), at=inside)


def select(df: DataFrame, keys: list[str], value: str | Column, weights: Weights, positions: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], weight: str | None = None, classes: list[str] | None = None, most: int = MOST) -> DataFrame:
    """keys, column, n (its weight) and the values at positions (from 0, interpolated; NaN gives NULL) by name.

    positions(n, low, high): from the weights of columns low..high to positions by name. weight: how many rows a row of df stands for.
    classes: further columns that the weights read (those of weights.classes are kept anyway). Columns without any row of a
    group of keys have n = 0; groups without a known value are absent.
    """
    value = F.col(value) if isinstance(value, str) else value
    kept = list(dict.fromkeys([*weights.classes, *(classes or [])]))
    known = df.select(*keys, *kept, value.cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("_w")).where("_v IS NOT NULL")
    if weights.classes:
        known = known.groupBy(*keys, *kept, "_v").agg(F.sum("_w").alias("_w"))
    rows, grouped, want = by_range(known, keys, [F.asc("_v")]), keys, None
    while True:
        tall = _tallies(rows, grouped, weights)
        if want is None:

            def first(tall: pd.DataFrame) -> pd.DataFrame:
                (parts, sums), block = _matrix(tall), int(tall["_block"].iloc[0])
                low = block * BLOCK
                n = sums.sum(0)
                found = _found(parts, sums, _ends(n, positions(n, low, low + len(n)), low), low).assign(_block=block)
                for k in keys:
                    found[k] = tall[k].iloc[0]
                return found[[*keys, "_block", "column", "name", "share", "n", "_part", "at"]]

            want = tall.groupBy(*keys, "_block").applyInPandas(first, _types(known, keys) + _WANTED)
        else:

            def again(tall: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
                if not len(wanted):
                    return wanted
                parts, sums = _matrix(tall)
                return _found(parts, sums, wanted.drop(columns="_part"), int(wanted["_block"].iloc[0]) * BLOCK)[wanted.columns.tolist()]

            schema = _types(rows, grouped) + _WANTED
            want = tall.groupBy(*grouped, "_block").cogroup(want.select(*grouped, "_block", "column", "name", "share", "n", F.lit(0).alias("_part"), "at").groupBy(*grouped, "_block")).applyInPandas(again, schema)
        want = stage(want, "wanted")
        if "_p0" not in want.columns:
            missing = want.where("_part < 0")
            want = want.where("_part >= 0")
        spots = want.select(*[F.col(k).alias(f"_k_{k}") for k in [*grouped, "_part"]]).distinct()
        rows = stage(rows.join(small(spots), _same([*grouped, "_part"])).select(*rows.columns), "near")
        largest = rows.groupBy(*grouped, "_part").count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            break
        name = f"_p{len(grouped) - len(keys)}"  # the range becomes a key of the next deal
        rows, want, grouped = rows.withColumnRenamed("_part", name), want.withColumnRenamed("_part", name), [*grouped, name]
        rows = by_range(rows, grouped, [F.asc("_v")])

    def pick(rows: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_v", kind="stable", ignore_index=True)
        v, w, at = rows["_v"].to_numpy(), rows["_w"].to_numpy(), want["at"].to_numpy()
        values = np.full(len(want), np.nan)
        column = want["column"].to_numpy()
        for block in np.unique(column // BLOCK).tolist():
            mine = np.flatnonzero(column // BLOCK == block)
            low, high = int(column[mine].min()), int(column[mine].max()) + 1
            done, step, open_ = np.zeros(high - low), max(1, CELLS // (high - low)), mine
            for a in range(0, len(rows), step):
                if not len(open_):
                    break
                upto = done + np.cumsum(w[a : a + step, None] * weights.of(rows.iloc[a : a + step], low, high), 0)
                over = upto[:, column[open_] - low] > at[open_][None, :]
                hit = over[-1]
                values[open_[hit]] = v[a + over[:, hit].argmax(0)]
                open_, done = open_[~hit], upto[-1]
        return want[[*keys, "column", "name", "n"]].assign(v=values * want["share"].to_numpy())

    schema = f"{_types(known, keys)}column int, name string, n double, v double"
    shared = [*grouped, "_part"]
    got = rows.groupBy(*shared).cogroup(want.groupBy(*shared)).applyInPandas(pick, schema)
    got = got.unionByName(missing.select(*keys, "column", "name", "n", F.lit(None).cast("double").alias("v")))
    names = list(positions(np.ones(1), 0, 1))
    return got.groupBy(*keys, "column").agg(F.max("n").cast("long").alias("n"), *[F.sum(F.when(F.col("name") == x, F.col("v"))).alias(x) for x in names])


def medians(df: DataFrame, keys: list[str], value: str | Column, weights: Weights, out: str = "median", weight: str | None = None, classes: list[str] | None = None, least: int = 1) -> DataFrame:
    """keys, column, n and each column's median; NULL where it has fewer than `least` rows."""
    return select(df, keys, value, weights, lambda n, low, high: {out: np.where(n >= max(1, least), (n - 1) * 0.5, np.nan)}, weight, classes)


def quantiles_left_out(df: DataFrame, subject: str, value: str | Column, subjects: list, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """fold (its subject's number in subjects), n and quantiles by name over all other subjects' rows."""
    found = select(df, [], value, left_out(subjects, subject), lambda n, low, high: {k: np.where(n > 0, (n - 1) * p, np.nan) for k, p in shares.items()}, weight)
    return found.withColumnRenamed("column", "fold")


def calibrated_splits(df: DataFrame, subjects: list, subject: str, score: str, error: str, calib: np.ndarray, share: float) -> DataFrame:
    """rep, threshold, coverage, md: of each split, the score that keeps rint(share * rows) of the calibrating subjects' rows, and what it keeps of the others: their share and median error.

    calib: subjects x splits, 1 where the subject calibrates. Rows without a score count as rows and are never kept.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(subject).count().collect()}  # a row per subject
    size = np.array([sizes.get(s, 0) for s in subjects], np.float64)
    k = np.rint(share * (size @ calib))
    known = select(df, [], score, drawn(calib, subjects, subject), lambda n, low, high: {"t": np.where((k[low:high] >= 1) & (k[low:high] <= n), n - k[low:high], np.nan)})
    found = {r["column"]: r["t"] for r in known.collect()}  # a row per split
    cut = np.array([np.inf if k[r] < 1 else -np.inf if found.get(r) is None else found[r] for r in range(calib.shape[1])])
    levels, place = np.unique(cut, return_inverse=True)
    rows = df.withColumn("_level", F.size(F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda t: t <= F.col(score))))  # levels that the row reaches
    held = np.vstack([1 - calib, np.zeros((1, calib.shape[1]))])

    def of(rows: pd.DataFrame, low: int, high: int) -> np.ndarray:
        return held[places(subjects, rows[subject]), low:high] * (rows["_level"].to_numpy()[:, None] > place[None, low:high])

    shown = medians(rows.where(F.col(score).isNotNull()), [], error, Weights(calib.shape[1], of, [subject, "_level"]), "md")
    told = values(df.sparkSession, [(r, float(cut[r]), float(size @ held[:-1, r])) for r in range(calib.shape[1])], "rep int, threshold double, _n double")
    return told.join(shown, F.col("rep") == F.col("column"), "left").select("rep", "threshold", F.try_divide(F.coalesce("n", F.lit(0)), F.col("_n")).alias("coverage"), "md")


# Prefix count vectors


def _bases(tally: DataFrame, keys: list[str], subjects: list, subject: str) -> DataFrame:
    """keys, _part, base (rows of each subject in the ranges before), total (in all), as doubles in bytes."""

    def run(tall: pd.DataFrame) -> pd.DataFrame:
        parts, at = np.unique(tall["_part"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(parts), len(subjects) + 1))
        np.add.at(counts, (at, places(subjects, tall[subject])), tall["_w"].to_numpy())
        before = np.vstack([np.zeros((1, counts.shape[1])), np.cumsum(counts, 0)])
        out = pd.DataFrame({"_part": parts, "base": [x.tobytes() for x in before[:-1]], "total": [before[-1].tobytes()] * len(parts)})
        for k in keys:
            out[k] = tall[k].iloc[0]
        return out[[*keys, "_part", "base", "total"]]

    return tally.groupBy(*keys).applyInPandas(run, _types(tally, keys) + "_part int, base binary, total binary")


def below_vectors(df: DataFrame, keys: list[str], order: dict[str, bool], subjects: list, subject: str) -> DataFrame:
    """df with _below (rows of each subject before the row in the order, as ints in bytes) and _total (of its group). order: columns and whether they ascend; it must tell all rows of a group apart."""
    ordering = [F.asc(c) if up else F.desc(c) for c, up in order.items()]
    rows = by_range(df, keys, ordering)
    tally = rows.groupBy("_part", *keys, subject).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    names = [c for c in df.columns]

    def run(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), ascending=list(order.values()), ignore_index=True)
        own = np.zeros((len(rows), len(subjects) + 1), np.int32)
        own[np.arange(len(rows)), places(subjects, rows[subject])] = 1
        below = (np.frombuffer(base["base"].iloc[0]).astype(np.int32) + np.cumsum(own, 0, np.int32) - own)[:, :-1]
        return rows[names].assign(_below=[x.tobytes() for x in below], _total=[np.frombuffer(base["total"].iloc[0])[:-1].astype(np.int32).tobytes()] * len(rows))

    shared = [*keys, "_part"]
    return rows.groupBy(*shared).cogroup(_bases(tally, keys, subjects, subject).groupBy(*shared)).applyInPandas(run, _types(df, names) + "_below binary, _total binary")


def best_of(matrix: np.ndarray, subjects: list, subject: str, shares: list[float]) -> Weights:
    """Column r * len(shares) + s: the best rint(shares[s] * n) of the rows that replicate r drew, by the order of below_vectors; a row in several copies may count with some of them."""
    wide = np.vstack([matrix, np.zeros((1, matrix.shape[1]), matrix.dtype)]).astype(np.float64)

    def of(rows: pd.DataFrame, low: int, high: int) -> np.ndarray:
        column = np.arange(low, high)
        reps, share = column // len(shares), np.array(shares)[column % len(shares)]
        first, last = int(reps.min()), int(reps.max()) + 1
        below = np.frombuffer(b"".join(rows["_below"]), np.int32).reshape(len(rows), -1).astype(np.float64)
        _, one, group = np.unique(rows["_total"].to_numpy(), return_index=True, return_inverse=True)
        totals = np.stack([np.frombuffer(rows["_total"].iloc[k], np.int32) for k in one]).astype(np.float64)
        place = (below @ wide[:-1, first:last])[:, reps - first]
        keep = np.rint((totals @ wide[:-1, first:last])[:, reps - first] * share[None, :])[group]
        copies = wide[places(subjects, rows[subject])][:, reps]
        return np.clip(keep - place, 0, copies)

    return Weights(matrix.shape[1] * len(shares), of)


_SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def _correlation(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column, n, spearman from sums over ranks; NULL where one of them doesn't vary."""
    g = sums.groupBy(*keys, "column").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    spread = lambda a, aa: F.greatest(F.try_divide(aa, n) - F.pow(F.try_divide(a, n), F.lit(2)), F.lit(0.0))
    vx, vy = spread(F.col("x"), F.col("xx")), spread(F.col("y"), F.col("yy"))
    cov = F.try_divide("xy", "n") - F.try_divide("x", "n") * F.try_divide("y", "n")
    return g.select(*keys, "column", n.cast("long").alias("n"), F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).alias("spearman"))


def _sum_rows(head: pd.DataFrame, columns: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    made = {"column": columns, "n": w.sum(0), "x": (w * x).sum(0), "y": (w * y).sum(0), "xx": (w * x * x).sum(0), "yy": (w * y * y).sum(0), "xy": (w * x * y).sum(0)}
    out = pd.DataFrame(made)
    for k in head.columns:
        out[k] = head[k].iloc[0]
    return out


def spearman_drawn(df: DataFrame, keys: list[str], x: str, y: str, matrix: np.ndarray, subjects: list, subject: str) -> DataFrame:
    """keys, column (replicate), n, spearman of x and y over the rows that each replicate drew, ties at the mean of their ranks."""
    rows = stage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, subject, x, y).agg(F.count(F.lit(1)).cast("double").alias("_w")), "pairs")
    both = rows
    for value, out in ((x, "_ux"), (y, "_uy")):
        counts = rows.groupBy(*keys, subject, F.col(value).alias("_v")).agg(F.sum("_w").alias("_w"))
        counts = by_range(counts, keys, [F.asc("_v")])
        tally = counts.groupBy("_part", *keys, subject).agg(F.sum("_w").alias("_w"))

        def run(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
            values, at = np.unique(rows["_v"].to_numpy(), return_inverse=True)
            own = np.zeros((len(values), len(subjects) + 1))
            np.add.at(own, (at, places(subjects, rows[subject])), rows["_w"].to_numpy())
            # Half of the group's total is taken off, so that ranks lie about 0 and their products stay exact.
            ranks = np.frombuffer(base["base"].iloc[0]) + np.cumsum(own, 0) - own / 2 - np.frombuffer(base["total"].iloc[0]) / 2
            made = pd.DataFrame({"_v": values, "_u": [r.tobytes() for r in ranks[:, :-1]]})
            for k in keys:
                made[k] = rows[k].iloc[0]
            return made[[*keys, "_v", "_u"]]

        shared = [*keys, "_part"]
        ranks = counts.groupBy(*shared).cogroup(_bases(tally, keys, subjects, subject).groupBy(*shared)).applyInPandas(run, f"{_types(counts, keys)}_v {rows.schema[value].dataType.simpleString()}, _u binary")
        ranks = stage(ranks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_v").alias("_ranked"), F.col("_u").alias(out)), "rank_vectors")
        both = both.join(ranks, (F.col(value) == F.col("_ranked")) & _same(keys)).select(*both.columns, out)
    wide = np.vstack([matrix, np.zeros((1, matrix.shape[1]), matrix.dtype)]).astype(np.float64)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        step = max(1, CELLS // wide.shape[1])
        for batch in batches:
            for key, group in batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]:
                for a in range(0, len(group), step):
                    part = group.iloc[a : a + step]
                    ux, uy = (np.frombuffer(b"".join(part[c])).reshape(len(part), -1) @ wide[:-1] for c in ("_ux", "_uy"))
                    w = part["_w"].to_numpy()[:, None] * wide[places(subjects, part[subject])]
                    made = _sum_rows(part[keys], np.arange(wide.shape[1]), w, ux, uy)
                    was = held.get(str(key))
                    if was is not None:
                        made[_SUMS] += was[_SUMS]
                    held[str(key)] = made
            if len(held) > 64:
                yield pd.concat(held.values())[[*keys, "column", *_SUMS]]
                held = {}
        if held:
            yield pd.concat(held.values())[[*keys, "column", *_SUMS]]

    schema = f"{_types(rows, keys)}column int, " + ", ".join(f"{c} double" for c in _SUMS)
    return _correlation(both.mapInPandas(add, schema), keys)


def _rank_pass(rows: DataFrame, keys: list[str], value: str, weights: Weights, block: int, make: Callable, schema: str) -> DataFrame:
    """make(rows sorted by value, their weights, their ranks less half the column's weight, first column) for each range, where weights differ by row and column."""
    low, high = block * BLOCK, min((block + 1) * BLOCK, weights.columns)
    rows = by_range(rows, keys, [F.asc(value)])
    one = Weights(high - low, lambda r, a, b: weights.of(r, low + a, low + b))
    tall = _tallies(rows.withColumn("_w", F.lit(1.0)), keys, one)

    def bases(tall: pd.DataFrame) -> pd.DataFrame:
        parts, sums = _matrix(tall)
        before = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)])
        out = pd.DataFrame({"_part": parts, "base": [(x - before[-1] / 2).tobytes() for x in before[:-1]]})
        for k in keys:
            out[k] = tall[k].iloc[0]
        return out[[*keys, "_part", "base"]]

    base = tall.groupBy(*keys).applyInPandas(bases, _types(rows, keys) + "_part int, base binary")

    def run(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(value, kind="stable", ignore_index=True)
        starts = np.flatnonzero(np.append(True, rows[value].to_numpy()[1:] != rows[value].to_numpy()[:-1]))
        done, out, step = np.frombuffer(base["base"].iloc[0]).copy(), [], max(1, CELLS // (high - low))
        a = 0
        while a < len(rows):
            # A block ends where a value ends; a value of more rows than a block is one block.
            after = starts[starts > a]
            fit = after[after <= a + step]
            b = int(fit[-1]) if len(fit) else (int(after[0]) if len(after) else len(rows))
            b = len(rows) if not len(after) or (len(rows) - a) <= step else b
            part = rows.iloc[a:b]
            w = weights.of(part, low, high)
            _, at = np.unique(part[value].to_numpy(), return_inverse=True)
            own = np.zeros((at.max() + 1, high - low))
            np.add.at(own, at, w)
            upto = done + np.cumsum(own, 0)
            out.append(make(part, w, (upto - own / 2)[at], low))
            done, a = upto[-1], b
        return pd.concat(out)

    shared = [*keys, "_part"]
    return rows.groupBy(*shared).cogroup(base.groupBy(*shared)).applyInPandas(run, schema)


def spearman_of_best(rows: DataFrame, keys: list[str], x: str, y: str, weights: Weights) -> DataFrame:
    """keys, column, n, spearman of x and y among the rows that count in each column (weights of best_of, over below_vectors)."""
    found = None
    names = [*keys, *[c for c in rows.columns if c not in keys]]
    for block in range(-(-weights.columns // BLOCK)):

        def ranked(part: pd.DataFrame, w: np.ndarray, ranks: np.ndarray, low: int) -> pd.DataFrame:
            use = w.any(1)
            return part[use][names].assign(_rx=[r.tobytes() for r in ranks[use].astype(np.float32)])  # halves up to 2^23

        def added(part: pd.DataFrame, w: np.ndarray, ranks: np.ndarray, low: int) -> pd.DataFrame:
            rx = np.frombuffer(b"".join(part["_rx"]), np.float32).reshape(w.shape).astype(np.float64)
            return _sum_rows(part[keys], np.arange(low, low + w.shape[1]), w, rx, ranks)[[*keys, "column", *_SUMS]]

        first = stage(_rank_pass(rows, keys, x, weights, block, ranked, _types(rows, names) + "_rx binary"), "ranked")
        sums = _rank_pass(first, keys, y, weights, block, added, f"{_types(rows, keys)}column int, " + ", ".join(f"{c} double" for c in _SUMS))
        found = sums if found is None else found.unionByName(sums)
    return _correlation(found, keys)
