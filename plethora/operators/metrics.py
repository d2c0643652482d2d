"""Agreement, error and ranking metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plethora.operators.cleaning import col
from plethora.operators.joins import small
from plethora.operators.order_stats import average_ranks, quantiles, running_sums, with_medians, with_quantiles
from plethora.sources.shared import stage


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation over rows that have both; NULL where one of them doesn't vary."""
    x, y = col(x), col(y)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def error_table(df: DataFrame, keys: list[str], estimate: str | Column, reference: str | Column, least: int = 3) -> DataFrame:
    """keys, n, median and mean absolute error, median percentage error, Pearson's r, Spearman's rho, Bland-Altman bias and limits; NULL below `least` pairs."""
    e, r = col(estimate), col(reference)
    both = stage(df.where(e.isNotNull() & r.isNotNull()).select(*keys, e.cast("double").alias("_e"), r.cast("double").alias("_r")), "pairs")
    d = F.col("_e") - F.col("_r")
    means = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), pearson("_e", "_r").alias("pearson"), F.avg(d).alias("bias"),
        (F.avg(d) - 1.96 * F.stddev_samp(d)).alias("loa_low"), (F.avg(d) + 1.96 * F.stddev_samp(d)).alias("loa_high"))
    out = with_medians(means, both, keys, {"md_ae": F.abs(d), "md_pe": 100 * F.try_divide(F.abs(d), F.col("_r"))})
    rho = spearman(both, keys, "_e", "_r").select(*[F.col(k).alias(f"_k_{k}") for k in keys], "spearman")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(rho, same, "left")
    return out.select(*keys, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("md_ae", "mae", "md_pe", "pearson", "spearman", "bias", "loa_low", "loa_high")])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """keys, n, spearman over rows that have both; ranks are those of distinct values. weight: how many rows a row stands for."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = stage(known.groupBy(*keys, x, y).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_m")), "pairs")
    pairs = both
    for c, out in ((x, "_rx"), (y, "_ry")):
        ranks = average_ranks(both, keys, c, "_m").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(c).alias("_ranked"), F.col("rank").alias(out))  # read once
        same = F.col(c) == F.col("_ranked")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        pairs = pairs.join(ranks, same).select(*pairs.columns, out)
    n, m = F.sum("_m"), F.col("_m")
    mean = lambda c: F.sum(m * c) / n
    sx, sy = F.col("_rx"), F.col("_ry")
    spread = F.sqrt(mean(sx * sx) - mean(sx) * mean(sx)) * F.sqrt(mean(sy * sy) - mean(sy) * mean(sy))
    return pairs.groupBy(*keys).agg(n.alias("n"), F.try_divide(mean(sx * sy) - mean(sx) * mean(sy), spread).alias("spearman"))


def confusion(df: DataFrame, keys: list[str], ref: str, shown: str) -> DataFrame:
    return df.groupBy(*keys, F.col(ref).alias("ref"), F.col(shown).alias("shown")).agg(F.count(F.lit(1)).alias("m"))


def kappa(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Cohen's kappa, agreement and n from confusion counts (ref, shown, m); NULL where chance agrees fully."""
    by = lambda c: F.sum("m").over(Window.partitionBy(*keys, c))
    n = F.sum("m").over(Window.partitionBy(*keys))
    d = counts.withColumns({"_row": by("ref"), "_col": by("shown"), "_n": n})
    # Each label's product of marginals, once: on its diagonal cell, or spread over the cells of its row by way of both marginals.
    marg = d.select(*keys, F.col("ref").alias("label"), F.col("_row").alias("r"), F.lit(0).alias("c"), "_n").distinct().union(d.select(*keys, F.col("shown").alias("label"), F.lit(0).alias("r"), F.col("_col").alias("c"), "_n").distinct())
    per_label = marg.groupBy(*keys, "label").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.max("_n").alias("n"))
    expected = per_label.groupBy(*keys).agg((F.sum(F.col("r") * F.col("c")) / F.max("n") / F.max("n")).alias("pe"))
    observed = d.groupBy(*keys).agg(F.max("_n").alias("n"), (F.sum(F.when(F.col("ref") == F.col("shown"), F.col("m")).otherwise(0)) / F.max("_n")).alias("agreement"))
    both = observed.join(expected, keys) if keys else observed.crossJoin(expected)
    return both.select(*keys, "n", "agreement", F.when(F.col("pe") < 1, (F.col("agreement") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def alarm_rates(ref: str, shown: str, calm: int = 1, weight: str | None = None) -> list[Column]:
    """false_alarm: shown above calm among calm ones; miss: shown calm among the others. NULL without any."""
    up, w = (F.col(shown) > calm).cast("double"), F.col(weight) if weight else F.lit(1)
    mean = lambda c: F.try_divide(F.sum(c * w), F.sum(F.when(c.isNotNull(), w)))
    return [mean(F.when(F.col(ref) == calm, up)).alias("false_alarm"), mean(F.when(F.col(ref) > calm, 1 - up)).alias("miss")]


def auroc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at half. label: 0 or 1. Class counts by distinct score are added up over ranges of the score, so no group meets in one task; a NULL score is below all others."""
    tie = df.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_m")).withColumn("_neg", F.col("_m") - F.col("_p"))
    tie = running_sums(tie, keys, [F.asc(score)], {"_upto": "_neg"})
    pos, neg = F.sum("_p"), F.sum("_neg")
    below = F.col("_upto") - F.col("_neg")
    return tie.groupBy(*keys).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos > 0) & (neg > 0), F.sum(F.col("_p") * (below + F.col("_neg") / 2.0)) / (pos * neg)).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Sum over thresholds of the recall gained times the precision there; ties are one threshold. NULL without a positive label. Counts are added up over ranges of the score."""
    tie = df.groupBy(*keys, score).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_m"))
    tie = running_sums(tie, keys, [F.desc(score)], {"_hits": "_p", "_shown": "_m"})
    return tie.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_p") * (F.col("_hits") / F.col("_shown"))), F.sum("_p")).alias("average_precision"))


def template_correlation(df: DataFrame, keys: list[str], segment: str, least: int = 5) -> DataFrame:
    """Mean, 10th percentile and share below 0.8 of the segments' cosines with their group's pointwise median, each segment less its mean. NULL below `least` segments.

    The template, a median per place of the segment, comes from ranges of the values, and so does the percentile.
    """
    plus = lambda a, x: a + x
    seg = F.transform(segment, lambda x: x.cast("double"))
    mean = F.aggregate(seg, F.lit(0.0), plus) / F.size(segment)
    d = stage(df.select(*keys, F.transform(seg, lambda x: x - mean).alias("_s")), "segments")
    points = d.select(*keys, F.posexplode("_s").alias("_place", "_v"))
    medians = quantiles(points, [*keys, "_place"], "_v", {"_t": 0.5})
    template = medians.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_t"))), lambda x: x["_t"]).alias("_tmpl"))  # a number per place
    template = template.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_tmpl")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), plus)
    c = dot("_s", "_tmpl") / (F.sqrt(dot("_s", "_s")) * F.sqrt(dot("_tmpl", "_tmpl")) + 1e-12)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    cosines = stage(d.join(small(template), same).select(*keys, c.alias("_c")), "cosines")
    n = F.count(F.lit(1))
    told = cosines.groupBy(*keys).agg(n.alias("n"), F.avg("_c").alias("corr_mean"), F.avg((F.col("_c") < 0.8).cast("double")).alias("frac_lt08"))
    told = with_quantiles(told, cosines, keys, "_c", {"corr_p10": 0.1})
    return told.select(*keys, "n", *[F.when(F.col("n") >= least, F.col(x)).alias(x) for x in ("corr_mean", "corr_p10", "frac_lt08")])
