"""Display gates and the evaluation of display rules, with thresholds from other subjects only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plethora.operators.cleaning import gate
from plethora.operators.joins import attach_first, small, values
from plethora.operators.metrics import alarm_rates, confusion, kappa
from plethora.operators.replicates import quantiles_left_out
from plethora.operators.resampling import subjects_of
from plethora.sources.shared import stage


def held_out_quantiles(df: DataFrame, subject: str, score: str, shares: dict[str, float]) -> DataFrame:
    """fold and, per name, the quantile of the score over all other subjects: counts of all by range, less the subject's own."""
    subjects = subjects_of(df, subject)
    named = values(df.sparkSession, list(enumerate(subjects)), f"_fold int, fold {df.schema[subject].dataType.simpleString()}")
    cuts = quantiles_left_out(df, subject, score, subjects, shares)
    return cuts.join(named, cuts["fold"] == F.col("_fold")).select(named["fold"], *shares)


def consistency_gates(df: DataFrame, subject: str, session: str, is_baseline: str, score: str, targets: dict[str, float]) -> DataFrame:
    """A boolean per target share: both the row and its session's baseline row reach the held-out quantile 1 - target. A gate that prefers low estimates is the same on the negative estimate."""
    based = attach_first(df, [session], F.col(is_baseline), score, "_base")
    cuts = held_out_quantiles(df, subject, score, {f"_{n}": 1 - t for n, t in targets.items()})
    shown = {n: gate(score, f"_{n}") & gate("_base", f"_{n}") for n in targets}
    return based.join(small(cuts), F.col(subject) == F.col("fold")).withColumns(shown).drop("_base", "fold", *[f"_{n}" for n in targets])


def evaluate_rules(df: DataFrame, rules: dict[str, tuple[str, str, str]], ref: str, ref_score: str, subject: str, draws: DataFrame, least: int = 10) -> DataFrame:
    """rule, n (shown), coverage of ALL rows, kappa, agreement, false_alarm and miss among the shown ones, score_mae, and 95 % bounds of the first three over replicates (<name>_lo, <name>_hi).

    rules: per name the level that it shows, the score behind it, and whether it shows a row; levels below 1 are never shown.
    draws: rep, subject, mult. Replicates weight the confusion counts of subjects, and need `least` shown rows.
    """
    on = lambda level, show: F.coalesce(F.col(show), F.lit(False)) & (F.coalesce(F.col(level), F.lit(0)) > 0)
    every = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(level).alias("shown"), F.abs(F.col(score) - F.col(ref_score)).alias("gap"), on(level, show).alias("on")) for n, (level, score, show) in rules.items()])
    long = stage(df.select(F.col(subject).alias(subject), F.col(ref).alias("ref"), F.explode(every).alias("r")).select(subject, "ref", "r.*"), "rules")
    seen = long.where("on")
    coverage = long.groupBy("rule").agg(F.avg(F.col("on").cast("double")).alias("coverage"))
    rates = seen.groupBy("rule").agg(*alarm_rates("ref", "shown"), F.avg("gap").alias("score_mae"))
    whole = coverage.join(kappa(confusion(seen, ["rule"], "ref", "shown"), ["rule"]), "rule", "left").join(rates, "rule", "left")
    counts = seen.groupBy("rule", subject, "ref", "shown").agg(F.count(F.lit(1)).alias("m"))
    reps = stage(bootstrap_agreement(counts, ["rule"], draws, subject, least), "replicates")
    names = ("kappa", "agreement", "false_alarm")
    bounds = reps.groupBy("rule").agg(*[F.percentile(c, p).alias(f"{c}_{e}") for c in names for e, p in (("lo", 0.025), ("hi", 0.975))])  # a value per replicate
    return whole.join(bounds, "rule", "left")


def bootstrap_agreement(counts: DataFrame, keys: list[str], draws: DataFrame, subject: str, least: int = 10, calm: int = 1) -> DataFrame:
    """keys, rep, n, agreement, kappa, false_alarm (NULL without calm rows) of each replicate with at least `least` rows, from confusion counts (keys, subject, ref, shown, m)."""
    own = [*keys, "rep"]
    drawn = stage(counts.join(draws, subject).groupBy(*own, "ref", "shown").agg(F.sum(F.col("m") * F.col("mult")).alias("m")), "drawn")
    quiet = F.col("ref") == calm
    alarms = drawn.groupBy(*own).agg(F.try_divide(F.sum(F.when(quiet & (F.col("shown") > calm), F.col("m")).otherwise(0)), F.sum(F.when(quiet, F.col("m")).otherwise(0))).alias("false_alarm"))
    return kappa(drawn, own).where(F.col("n") >= least).join(alarms, own)


def frozen_protocol(tracking: float, comparator: float, coverage: float, margin: float = 0.05, least_coverage: float = 0.25) -> dict[str, bool]:
    """Pass or fail of a frozen rule on a new dataset: rank tracking within the margin of the comparator's, at enough coverage."""
    found = {"tracking": tracking >= comparator - margin, "coverage": coverage >= least_coverage}
    return found | {"passed": all(found.values())}
