"""Order statistics of groups of which one may hold most rows: quantiles, n-th values, ranks, prefixes of a ranking.

Spark's exact percentile keeps a group's distinct values in one buffer, and a window brings a group to one task. Here rows are
dealt by ranges of the value instead, and written to the shared folder (they would not come out equal if they were dealt
twice). Counts per range and group, a small table, tell in which range each statistic lies and how far into it; only the
rows of that range are sorted for it. Work is one shuffle of the values, and no task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plethora.operators.joins import SMALL, small
from plethora.sources.shared import stage


#: Places that a group's values are told apart by before any of them is sorted.
PLACES = 1 << 12


def _same(keys: list[str], other: str = "_k_") -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).eqNullSafe(F.col(other + k))
    return found


def _renamed(df: DataFrame, keys: list[str], *rest: str | Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *rest)


def by_range(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df dealt by ranges of keys and order, as a table: _part is the number of the range. The number of ranges is given, as adaptive execution would merge small ones into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *[F.asc(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str | None], totals: dict[str, str] | None = None) -> DataFrame:
    """Per name of sums: its column added up to and with each row in its group (None: rows counted from 1). totals: further names, each for a name of sums, with its sum over the group."""
    d = by_range(df, keys, order).withColumnRenamed("_part", "_range")
    names = {out: f"_n{k}" for k, out in enumerate(sums)}
    counts = d.groupBy("_range", *keys).agg(*[(F.sum(w) if w else F.count(F.lit(1))).alias(names[out]) for out, w in sums.items()])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    told = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names.values()] + [F.sum(n).over(group).alias(f"{n}_total") for n in names.values()]
    counts = _renamed(counts, keys, F.col("_range").alias("_part"), *told)
    w = Window.partitionBy("_range", *keys).orderBy(*order)
    local = {f"{names[out]}_local": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) if c else F.row_number().over(w) for out, c in sums.items()}
    d = d.withColumns(local).join(small(counts), (F.col("_range") == F.col("_part")) & _same(keys))
    found = [(F.col(f"{names[out]}_before") + F.col(f"{names[out]}_local")).alias(out) for out in sums]
    return d.select(*df.columns, *found, *[F.col(f"{names[of]}_total").alias(out) for out, of in (totals or {}).items()])


def running(df: DataFrame, keys: list[str], order: list[Column], out: str, weight: str | None = None, total: str | None = None) -> DataFrame:
    """out: the sum of the weights up to and with each row in its group (without weights: its number, from 1); total: that of the group."""
    return running_sums(df, keys, order, {out: weight}, {total: out} if total else None)


def running_max(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], inclusive: bool = True, ties: bool = False) -> DataFrame:
    """Per name the greatest value (of a type with an order, NULLs left out) of the group's rows up to this one, or before it.

    ties: rows of equal order count as one place; order is then one column. Rows are dealt by ranges; the greatest of the
    ranges before comes from a small table, so one group may hold most rows.
    """
    held = {f"_m{k}": v for k, v in enumerate(values.values())}
    d = by_range(df.withColumns(held), keys, order).withColumnRenamed("_part", "_range")
    per = d.groupBy("_range", *keys).agg(*[F.max(m).alias(m) for m in held])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = _renamed(per, keys, F.col("_range").alias("_part"), *[F.max(m).over(before).alias(f"{m}_before") for m in held])
    w = Window.partitionBy("_range", *keys).orderBy(*order)
    w = (w.rangeBetween if ties else w.rowsBetween)(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumns({f"{m}_local": F.max(m).over(w) for m in held}).join(small(per), (F.col("_range") == F.col("_part")) & _same(keys))
    return d.select(*df.columns, *[F.greatest(f"{m}_local", f"{m}_before").alias(out) for out, m in zip(values, held)])


def picked(df: DataFrame, keys: list[str], value: str | Column, at: Callable[[Column], dict[str, Column]], weight: str | None = None, bucket: Column | None = None, points: int = 1) -> DataFrame:
    """keys, n (known values, weighted) and the values at positions (from 0; between two they are interpolated; NULL gives NULL).

    at: from n to positions by name. bucket: a number from 0; there are as many results as points, numbered _point, and each is
    over the rows of buckets up to g. Rows of later buckets count nowhere.
    """
    value = F.col(value) if isinstance(value, str) else value
    known = df.select(*keys, value.cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"), (F.lit(0) if bucket is None else bucket.cast("int")).alias("_b"))
    # Rows of one value are one row with their weight, so a value that most rows share doesn't fill a range.
    known = known.where(F.col("_v").isNotNull() & (F.col("_b") < points)).groupBy(*keys, "_v", "_b").agg(F.sum("_w").alias("_w"))
    d = by_range(known, keys, [F.asc("_v")])
    per = d.groupBy("_part", *keys, "_b").agg(F.sum("_w").alias("_m")).withColumn("_point", F.explode(F.sequence("_b", F.lit(points - 1))))
    per = per.groupBy("_part", *keys, "_point").agg(F.sum("_m").alias("_m"))
    group = Window.partitionBy(*keys, "_point")
    before = F.coalesce(F.sum("_m").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = stage(per.withColumns({"_before": before, "n": F.sum("_m").over(group)}), "counts")
    names = list(at(F.col("n")))
    ends = []
    for name, position in at(F.col("n")).items():
        low = F.floor(position)
        ends += [F.struct(F.lit(name).alias("name"), low.alias("idx"), (1 - (position - low)).cast("double").alias("share")), F.struct(F.lit(name).alias("name"), (low + 1).alias("idx"), (position - low).cast("double").alias("share"))]
    wanted = per.withColumn("_p", F.explode(F.array(*ends))).where((F.col("_p.share") > 0) & (F.col("_p.idx") >= F.col("_before")) & (F.col("_p.idx") < F.col("_before") + F.col("_m")))
    wanted = stage(_renamed(wanted, keys, F.col("_part").alias("_range"), F.col("_point").alias("_pt"), "_p.name", (F.col("_p.idx") - F.col("_before")).alias("_at"), "_p.share"), "wanted")
    size = wanted.count()
    spots = wanted.select("_range", "_pt", *[f"_k_{k}" for k in keys]).distinct()
    rows = d.join(small(spots, size), (F.col("_part") == F.col("_range")) & _same(keys) & (F.col("_b") <= F.col("_pt"))).select(*keys, "_part", F.col("_pt").alias("_point"), "_v", "_w")
    upto = F.sum("_w").over(Window.partitionBy("_part", *keys, "_point").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto)
    hit = rows.join(small(wanted, size), (F.col("_part") == F.col("_range")) & _same(keys) & (F.col("_point") == F.col("_pt")) & (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_w")))
    found = hit.groupBy(*keys, "_point").agg(*[F.sum(F.when(F.col("name") == name, F.col("share") * F.col("_v"))).alias(name) for name in names])
    found = _renamed(found, keys, F.col("_point").alias("_pt"), *names)
    groups = per.select(*keys, "_point", "n").distinct()
    out = groups.join(found, _same(keys) & (F.col("_point") == F.col("_pt")), "left").select(*keys, "_point", "n", *names)  # a row per group on either side
    return out if points > 1 else out.drop("_point")


def picked_in_table(df: DataFrame, keys: list[str], value: str | Column, at: Callable[[Column], dict[str, Column]], weight: str | None = None) -> DataFrame:
    """picked() of a table with few groups: what thinned() leaves is sorted by group while it has at most SMALL rows, and dealt by ranges otherwise."""
    left = thinned(df, keys, value, at, weight)
    if left.count() > SMALL:
        return picked(left, keys, "_v", at, "_w")
    group = Window.partitionBy(*keys)
    d = left.withColumns({"_upto": F.sum("_w").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_w").over(group)})
    inside = lambda place: (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_w"))
    found = []
    for name, position in at(F.col("n")).items():
        low, part = F.floor(position), position - F.floor(position)
        below, above = F.sum(F.when(inside(low), (1 - part) * F.col("_v"))), F.sum(F.when(inside(low + 1) & (part > 0), part * F.col("_v")))
        found.append(F.coalesce(below + above, below).alias(name))
    return d.groupBy(*keys).agg(F.max("n").alias("n"), *found).where("n IS NOT NULL")


def thinned(df: DataFrame, keys: list[str], value: str | Column, at: Callable[[Column], dict[str, Column]], weight: str | None = None) -> DataFrame:
    """keys, _v, _w: rows in which picked() finds what it finds in df, a table that may be read three times instead of being dealt by ranges.

    Each group's values fall into PLACES places of equal width. Counts tell in which of them a position lies; the rows of any other place
    are one row with their weight, so only those near a position are sorted. Values without a finite spread are all in one place.
    """
    value = F.col(value) if isinstance(value, str) else value
    known = df.select(*keys, value.cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")).where("_v IS NOT NULL")
    spans = known.groupBy(*keys).agg(F.min("_v").alias("_low"), (F.max("_v") - F.min("_v")).alias("_span"), F.sum("_w").alias("_n"))
    place = F.least(F.floor((F.col("_v") - F.col("_low")) / F.col("_span") * PLACES), F.lit(PLACES - 1))
    place = F.when((F.col("_span") > 0) & (F.col("_span") < float("inf")), place).otherwise(0)
    d = known.join(small(_renamed(spans, keys, "_low", "_span", "_n")), _same(keys)).select(*keys, "_v", "_w", "_n", place.alias("_at"))
    per = d.groupBy(*keys, "_at").agg(F.min("_v").alias("_v"), F.sum("_w").alias("_w"), F.max("_n").alias("_n"))
    per = per.withColumn("_upto", F.sum("_w").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    near = F.lit(False)
    for position in at(F.col("_n")).values():
        low = F.floor(position)
        near = near | F.coalesce((low < F.col("_upto")) & (low + 1 >= F.col("_upto") - F.col("_w")), F.lit(False))
    per = stage(per.withColumn("_near", near), "places")
    some = d.join(small(_renamed(per.where("_near"), keys, F.col("_at").alias("_place"))), (F.col("_at") == F.col("_place")) & _same(keys))
    return stage(some.select(*keys, "_v", "_w").unionByName(per.where("NOT _near").select(*keys, "_v", "_w")), "thinned")


def quantiles(df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float], weight: str | None = None, table: bool = False) -> DataFrame:
    """keys, n and linearly interpolated quantiles by name; NULL values are left out, and groups without any other. table: whether df is one, with few groups (see picked_in_table)."""
    at = lambda n: {name: (n - 1) * share for name, share in shares.items()}
    return (picked_in_table if table else picked)(df, keys, value, at, weight)


def with_quantiles(table: DataFrame, df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float], weight: str | None = None, reread: bool = False) -> DataFrame:
    """table, a row per group of keys, with quantiles of df's groups added. reread: whether df is a table, with few groups (see picked_in_table)."""
    found = _renamed(quantiles(df, keys, value, shares, weight, reread), keys, *shares)
    return table.join(found, _same(keys), "left").select(*table.columns, *shares)


def with_medians(table: DataFrame, df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """table, a row per group of keys, with the medians of several values of df's groups added; all of them in one order."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("_which"), v.cast("double").alias("_value")) for name, v in values.items()])).alias("_x")).select(*keys, "_x.*")
    found = quantiles(long, [*keys, "_which"], "_value", {"_median": 0.5})
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == name, F.col("_median"))).alias(name) for name in values])
    return table.join(_renamed(wide, keys, *values), _same(keys), "left").select(*table.columns, *values)


def average_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, value, rank: of each distinct value, from 1; equal ones share the mean of their ranks."""
    counts = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_m"))
    return running(counts, keys, [F.asc(value)], "_upto", "_m").select(*keys, value, (F.col("_upto") - (F.col("_m") - 1) / 2.0).alias("rank"))
