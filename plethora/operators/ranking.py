"""Ranking by a quality score: risk against coverage, thresholds, matched subsets, conformal quantiles.

Ties end with a unique row id, so every result is determined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plethora.operators.joins import small
from plethora.operators.order_stats import picked, picked_in_table, quantiles, running
from plethora.sources.shared import stage


def coverage_grid(start: float, stop: float, step: float) -> list[float]:
    n = round((stop - start) / step) + 1
    return [round(start + k * step, 10) for k in range(n)]


def ranked(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """rn: place by score, highest first; n: rows of the group."""
    return running(df, keys, [F.desc(score), *map(F.asc, ties)], "rn", total="n")


def risk_coverage(df: DataFrame, keys: list[str], score: str, error: str, grid: list[float], ties: list[str], total: Column | None = None, least: int = 5, known: DataFrame | None = None) -> DataFrame:
    """c, k, risk: median error of the best k = rint(c * total) rows, at each coverage c of the ascending grid; only where least <= k <= n. total: rows of the group if not given. known: ranked() of df, where it is there already.

    Each row belongs to the first coverage that takes it in; medians of all prefixes come from one order of the errors.
    """
    d = (ranked(df, keys, score, *ties) if known is None else known).withColumn("_total", F.col("n") if total is None else total)
    points = F.array(*map(F.lit, grid))
    k = lambda c: F.rint(c * F.col("_total")).cast("long")
    d = stage(d.select(*keys, F.col(error).alias("_e"), "n", "_total", F.size(F.filter(points, lambda c: k(c) < F.col("rn"))).alias("_first")), "first_points")
    groups = d.groupBy(*keys).agg(F.max("n").alias("_n"), F.max("_total").alias("_total"))
    groups = groups.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_n", "_total")
    found = picked(d, keys, "_e", lambda n: {"risk": (n - 1) * 0.5}, bucket=F.col("_first"), points=len(grid))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    found = found.join(small(groups), same).withColumn("c", F.get(points, F.col("_point"))).withColumn("k", k(F.col("c")))
    return found.where((F.col("k") >= least) & (F.col("k") <= F.col("_n"))).select(*keys, "c", "k", "risk")


def aurc(curve: DataFrame, keys: list[str], method: str, base: float | Column, oracle: str = "oracle") -> DataFrame:
    """Mean risk of each method's curve, and the share of the way from base to the oracle that it goes."""
    area = curve.groupBy(*keys, method).agg(F.avg("risk").alias("aurc"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    best = F.max(F.when(F.col(method) == oracle, F.col("aurc"))).over(w)
    base = base if isinstance(base, Column) else F.lit(base)
    return area.withColumn("gap_closed", (base - F.col("aurc")) / (base - best))


def threshold_for_share(df: DataFrame, keys: list[str], score: str, share: float, weight: str | None = None) -> DataFrame:
    """The score that keeps rint(share * rows) of ALL rows: infinite for none, minus infinite where too few have a score. weight: how many rows a row stands for."""
    every = df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_all"), (F.sum(F.when(F.col(score).isNotNull(), F.col(weight) if weight else F.lit(1)))).alias("_known"))
    every = stage(every.withColumn("k", F.rint(F.lit(share) * F.col("_all")).cast("long")), "shares")
    # The k-th from the top is the (known - k)-th from below; k differs by group, so each group's position is looked up beside its rows.
    marked = _beside(df, every, keys).withColumn("_score", F.col(score))
    found = picked(marked, [*keys, "_all", "k"], "_score", lambda n: {"t": F.when((F.col("k") >= 1) & (F.col("k") <= n), n - F.col("k"))}, weight)
    t = _beside(every, found.select(*keys, "t"), keys, "left")
    return t.select(*keys, F.col("_all").alias("n"), "k", F.when(F.col("k") <= 0, F.lit(float("inf"))).otherwise(F.coalesce("t", F.lit(float("-inf")))).alias("threshold"))


def _beside(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of a small table of a row per group."""
    rest = [c for c in table.columns if c not in keys]
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(small(table.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *rest)), same, how).select(*df.columns, *rest)


def split_at_half(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """kept: whether the row is in the better half."""
    return ranked(df, keys, score, *ties).withColumn("kept", F.col("rn") <= F.rint(F.col("n") * 0.5)).drop("rn", "n")


def conformal_quantile(df: DataFrame, keys: list[str], score: str, alpha: float, weight: str | None = None, table: bool = False) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score, infinite where that exceeds n; fails on a group without scores. weight: how many rows a row stands for. table: whether df is one, with few groups (see order_stats.picked_in_table)."""
    every = df.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col(score).isNotNull(), F.col(weight))), F.lit(0)) if weight else F.count(score)).alias("n"))
    k = lambda n: F.ceil((n + 1) * F.lit(1 - alpha))
    at = lambda n: {"q": F.when(k(n) <= n, k(n) - 1)}
    found = (picked_in_table if table else picked)(df, keys, score, at, weight).select(*keys, "q")
    got = _beside(every, found, keys, "left")
    q = F.when(F.col("n") == 0, F.raise_error(F.lit("at least one score is needed")).cast("double")).when(k(F.col("n")) > F.col("n"), F.lit(float("inf"))).otherwise(F.col("q"))
    return got.select(*keys, "n", q.alias("q"))


def conformal_rank_value(scores: list[float], alpha: float) -> float:
    """The same of a list in the driver."""
    import math

    if not scores:
        raise ValueError("at least one score is needed")
    k = math.ceil((len(scores) + 1) * (1 - alpha))
    return sorted(scores)[k - 1] if k <= len(scores) else math.inf


def quiet_subset(df: DataFrame, keys: list[str], value: str, share: float = 0.2) -> DataFrame:
    """Rows up to the share's quantile of the value in their group."""
    bound = quantiles(df, keys, value, {"_q": share}).drop("n")
    return _beside(df, bound, keys).where(F.col(value) <= F.col("_q")).drop("_q")
