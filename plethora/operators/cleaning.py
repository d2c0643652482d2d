"""Projections, predicates and cleaning of signals and window tables.

Missing values are NULL everywhere; ``nan_to_null`` does that once, where data come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b of doubles as IEEE has it: infinite, or NaN for 0 / 0, where Spark's division fails."""
    a, b = col(a), col(b)
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns as NULL."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def interpolate_gaps(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Linear interpolation over NULLs along order; before the first and after the last known value it is held. Without any known value: 0."""
    # Looked at backwards: a frame that ends at the last row would be read anew for each row.
    ahead = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known_at = F.when(F.col(value).isNotNull(), F.col(order))
    x0, y0 = F.last(known_at, True).over(back), F.last(value, True).over(back)
    x1, y1 = F.last(known_at, True).over(ahead), F.last(value, True).over(ahead)
    inner = y0 + (y1 - y0) * ((F.col(order) - x0) / (x1 - x0))
    return df.withColumn(out, F.coalesce(value, F.when(x0.isNull(), y1).when(x1.isNull(), y0).otherwise(inner), F.lit(0.0)))


def count_missing(value: str) -> Column:
    return F.count_if(F.col(value).isNull() | F.isnan(F.col(value)))


def magnitude(*axes: str) -> Column:
    return F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))


def invert_polarity(value: str, key: str) -> Column:
    """Mirrored at the median of its recording."""
    return 2 * F.median(value).over(Window.partitionBy(key)) - F.col(value)


def parse_record(name: str) -> tuple[Column, Column]:
    """(subject, activity) of a recording named like s12_walk."""
    return F.regexp_extract(name, r"^s(\d+)_", 1).cast("int"), F.substring_index(F.col(name), "_", -1)


def reference_valid(ref: str, reject_frac: str | None = None, most: float = 0.10) -> Column:
    ok = F.col(ref).isNotNull()
    return ok & F.coalesce(F.col(reject_frac) <= most, F.lit(False)) if reject_frac else ok


def kept(estimate: str | Column, component: str | Column, tau: str | Column | float) -> Column:
    """The gate: there is an estimate, and its quality reaches tau; tau 0 lets all pass, an unknown quality passes no other."""
    tau = tau if isinstance(tau, (str, Column)) else F.lit(tau)
    return col(estimate).isNotNull() & ((col(tau) <= 0) | F.coalesce(col(component) >= col(tau), F.lit(False)))


def gate(value: str | Column, threshold: str | Column | float) -> Column:
    """NULL is below every threshold."""
    threshold = threshold if isinstance(threshold, (str, Column)) else F.lit(threshold)
    return F.coalesce(col(value) >= col(threshold), F.lit(False))


def sqi_components(reject: str, mod_score: str, penalty: str, per: str) -> tuple[Column, Column]:
    """(amplitude, periodicity) parts of the quality index, for ablation."""
    early = F.col(reject).isin("warmup", "presence", "flat")
    return F.when(early | (F.col(reject) == "zombie"), 0.0).otherwise(F.col(mod_score) * F.col(penalty)), F.when(early, 0.0).otherwise(F.col(per))


def evaluable(baseline: str, ref_ok: str, level: str) -> Column:
    return ~F.col(baseline) & F.coalesce(F.col(ref_ok), F.lit(False)) & F.coalesce(F.col(level) > 0, F.lit(False))


def band(score: str | Column, high: float = 65, low: float = 35) -> Column:
    return F.when(col(score) >= high, 3).when(col(score) >= low, 2).otherwise(1)


def rejection_proxy(n_peaks: str | Column, n_accepted: str | Column) -> Column:
    """Share of peaks that closed no accepted interval, within 0 and 1; without peaks 1."""
    share = 1 - col(n_accepted) / F.greatest(col(n_peaks), F.lit(1))
    return F.when(F.coalesce(col(n_peaks), F.lit(0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(1.0)


def fill_worst(score: str, *key: str) -> Column:
    """A missing score ranks below the least one of its group; without any it is -1."""
    return F.coalesce(F.col(score), F.min(score).over(Window.partitionBy(*key)) - 1, F.lit(-1.0))


def block_key(subject: str, t0: str, seconds: int = 600) -> Column:
    return F.concat_ws("_", F.col(subject).cast("string"), F.floor(F.col(t0) / seconds).cast("string"))


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, which fails when it runs if two rows share a key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return df.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"rows share {', '.join(key)}")).cast("boolean"))).drop("_n")


def unmatched(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Keys of either side that the other lacks; empty if the two are aligned."""
    a, b = left.select(*key), right.select(*key)
    return a.join(b, list(key), "left_anti").withColumn("side", F.lit("left")).union(b.join(a, list(key), "left_anti").withColumn("side", F.lit("right")))


def looked_up(names: dict, key: Column) -> Column:
    """The key's entry in a map; NULL for other keys."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key.cast("int"))
