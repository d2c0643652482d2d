"""Interval variability: RMSSD in its variants, rolling rates and per-window interval features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def rmssd(difference: str | Column) -> Column:
    """Root of the mean square of successive differences; 0 without any."""
    d = F.col(difference) if isinstance(difference, str) else difference
    return F.coalesce(F.sqrt(F.avg(d * d)), F.lit(0.0))


def with_difference(df: DataFrame, value: str, over: WindowSpec, out: str = "diff") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(over))


def window_rmssd(df: DataFrame, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """RMSSD of each group, NULL with fewer than `least` intervals; n."""
    d = with_difference(df, value, Window.partitionBy(*keys).orderBy(*order))
    return d.groupBy(*keys).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, rmssd("diff")).alias("rmssd"))


def reference_rmssd(df: DataFrame, keys: list[str], order: list[str], value: str, low: float = 300.0, high: float = 2000.0, least: int = 20) -> DataFrame:
    """Differences count only between two valid neighbours (both within the bounds, ends included)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ok = F.col(value).between(low, high)
    pairs = df.withColumns({"ok": ok, "pair": F.when(ok & F.lag(ok).over(w), F.col(value) - F.lag(value).over(w))})
    return pairs.groupBy(*keys).agg(F.count_if("ok").alias("n_valid"), F.when(F.count_if("ok") >= least, F.sqrt(F.avg(F.col("pair") * F.col("pair")))).alias("rmssd"))


def centred_median(value: str, w: WindowSpec, half: int = 5) -> Column:
    """Median of the known ones of the 2 * half + 1 values around a row; beyond the ends the first and last value are repeated. NULL without any known.

    Spark has no median over a frame, so the frame is gathered (at most 2 * half + 1 values, in structs, as NULLs would be
    left out and shift it) and padded.
    """
    boxed = F.struct(F.col(value).alias("v"))
    before, after = F.collect_list(boxed).over(w.rowsBetween(-half, -1)), F.collect_list(boxed).over(w.rowsBetween(1, half))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.array_repeat(F.first(boxed).over(whole), F.lit(half) - F.size(before))
    tail = F.array_repeat(F.last(boxed).over(whole), F.lit(half) - F.size(after))
    known = F.array_compact(F.transform(F.concat(head, before, F.array(boxed), after, tail), lambda x: x["v"]))
    return F.get(F.array_sort(known), F.floor(F.size(known) / 2).cast("int"))


def clean_rmssd(df: DataFrame, keys: list[str], order: list[str], value: str, low: float = 300.0, high: float = 2000.0, tolerance: float = 0.20, least: int = 20) -> DataFrame:
    """As reference_rmssd, but a valid interval also lies within the tolerance of the median of its 11 neighbours; reject_frac, and as many pairs less one are needed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("med", centred_median(value, w))
    ok = F.col(value).between(low, high) & (F.abs(F.col(value) - F.col("med")) <= tolerance * F.col("med"))
    d = d.withColumn("ok", ok).withColumn("pair", F.when(F.col("ok") & F.lag("ok").over(w), F.col(value) - F.lag(value).over(w)))
    n, n_ok = F.count(value), F.count_if("ok")
    enough = (n >= least) & (n_ok >= least) & (F.count("pair") >= least - 1)
    return d.groupBy(*keys).agg(
        n.alias("n"), n_ok.alias("n_valid"),
        F.when(n >= least, 1 - F.avg(F.col("ok").cast("double"))).alias("reject_frac"),
        F.when(enough, F.sqrt(F.avg(F.col("pair") * F.col("pair")))).alias("rmssd"),
        F.when(enough, 60000.0 / F.median(F.when(F.col("ok"), F.col(value)))).alias("hr"))


def rate_of_last(value: str, over: WindowSpec, least: int = 3) -> Column:
    """60000 over the median of a frame's intervals, NULL with fewer than `least`."""
    found = F.array_sort(F.collect_list(value).over(over))
    n = F.size(found)
    middle = (F.get(found, F.floor((n - 1) / 2).cast("int")) + F.get(found, F.floor(n / 2).cast("int"))) / 2
    return F.when(n >= least, 60000.0 / middle)


def periodicity(value: str, over: WindowSpec) -> Column:
    """1 - half the coefficient of variation, within 0 and 1; 0 with fewer than three intervals."""
    mean = F.avg(value).over(over)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.5 * F.stddev_pop(value).over(over) / mean))
    return F.when((F.count(value).over(over) >= 3) & (mean > 0), score).otherwise(0.0)


def interval_features(df: DataFrame, keys: list[str], order: list[str], value: str, n_peaks: Column, window_ms: float = 60000.0, least: int = 3) -> DataFrame:
    """Rate, missed-beat estimate and spread of a window's intervals; all NULL with fewer than `least`. n_peaks: an aggregate."""
    d = with_difference(df, value, Window.partitionBy(*keys).orderBy(*order))
    med, step, enough = F.median(value), F.abs("diff"), F.count(value) >= least
    missed = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - n_peaks / (window_ms / med)))
    found = {"hr": 60000.0 / med, "miss_frac_est": missed, "rr_cv": F.stddev_pop(value) / F.avg(value), "rr_diff_mad_rel": F.median(step) / med, "rr_diff_max_rel": F.max(step) / med, "rmssd": rmssd("diff")}
    return d.groupBy(*keys).agg(F.count(value).alias("n"), *[F.when(enough, c).alias(k) for k, c in found.items()])
