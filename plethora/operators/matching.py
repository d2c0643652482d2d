"""One-to-one matches of detected and reference times within a tolerance.

Times closer than the tolerance form a chain; nothing in one chain can match anything in another, so chains are dealt out apart, many to
a group, and a recording of any length spreads over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plethora.operators.joins import small
from plethora.operators.order_stats import running_max, with_medians
from plethora.operators.replay import each_group
from plethora.sources.shared import stage

#: Times of a group, about.
GROUP = 20_000


def matched_pairs(found: np.ndarray, wanted: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """(wanted, found) numbers of sorted times: each wanted time in turn takes the nearest free one of the found times beside it.

    Neighbours and gaps come from one search; only whether a time is still free depends on the turns before.
    """
    right = np.searchsorted(found, wanted)
    beside = np.stack([right - 1, right], 1)
    wide = np.concatenate([[-np.inf], found, [np.inf]])
    gap = np.abs(wide[beside + 1] - wanted[:, None])
    order = np.argsort(gap, axis=1, kind="stable")  # of equal gaps the earlier time comes first
    sides = np.where(np.take_along_axis(gap, order, 1) <= tolerance, np.take_along_axis(beside, order, 1), -1)
    free, pairs = np.ones(len(found), bool), []
    for k, sides_of in enumerate(sides.tolist()):
        for j in sides_of:
            if j >= 0 and free[j]:
                free[j] = False
                pairs.append((k, j))
                break
    return pairs


def figures_of(found: np.ndarray, wanted: np.ndarray, tolerance: float) -> dict[str, list]:
    """A row of match_summary() for one recording, whose times are at hand in its group."""
    found, wanted = np.sort(found), np.sort(wanted)
    pairs = np.array(matched_pairs(found, wanted, tolerance), int).reshape(-1, 2)
    tp, gaps = len(pairs), np.sort(np.abs(found[pairs[:, 1]] - wanted[pairs[:, 0]]))
    error = 0.5 * gaps[(tp - 1) // 2] + 0.5 * gaps[tp // 2] if tp else None
    return {"tp": [tp], "sensitivity": [tp / len(wanted) if len(wanted) else None], "ppv": [tp / len(found) if len(found) else None], "error": [error]}


def chained(times: DataFrame, key: str, time: str, tolerance: float, group: int = GROUP) -> DataFrame:
    """times with _group: chains of times at most the tolerance apart are whole in it. A chain is known by its first time."""
    d = running_max(times, [key], [F.asc(time)], {"_before": F.col(time)}, inclusive=False)
    begins = F.when(F.col("_before").isNull() | (F.col(time) - F.col("_before") > tolerance), F.col(time))
    d = running_max(d.withColumn("_first", begins).drop("_before"), [key], [F.asc(time), F.asc_nulls_last("_first")], {"_chain": F.col("_first")})
    sizes = times.groupBy(F.col(key).alias("_g_key")).agg(F.ceil(F.count(F.lit(1)) / group).alias("_groups"))
    d = d.join(small(sizes), F.col(key).eqNullSafe(F.col("_g_key")))
    return d.withColumn("_group", F.pmod(F.xxhash64("_chain"), F.col("_groups"))).drop("_first", "_chain", "_groups", "_g_key")


def nearest_match(detected: DataFrame, reference: DataFrame, key: str, time: str, tolerance: float, group: int = GROUP) -> DataFrame:
    """key, ref_time, det_time: greedy one-to-one matches in the order of the reference, each to the nearer free one of its two neighbours. Rows without a key or a time match nothing."""
    side = lambda df, is_ref: df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.col(time), F.lit(is_ref).alias("_ref"))
    both = chained(side(detected, False).unionByName(side(reference, True)), key, time, tolerance, group)

    def match(group: dict[str, np.ndarray]) -> dict[str, list]:
        at, ref = group["_o"], group["_ref"].astype(bool)
        d, r = at[~ref], at[ref]
        if not len(d) or not len(r):
            return {"ref_time": [], "det_time": []}
        pairs = np.array(matched_pairs(d, r, tolerance), int).reshape(-1, 2)
        return {"ref_time": r[pairs[:, 0]].tolist(), "det_time": d[pairs[:, 1]].tolist()}

    kind = both.schema[time].dataType.simpleString()
    rows = both.select(key, "_group", F.col(time).alias("_o"), "_ref")
    return each_group(rows, [key, "_group"], match, f"ref_time {kind}, det_time {kind}").select(key, "ref_time", "det_time")


def match_summary(matches: DataFrame, detected: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """tp, sensitivity, positive predictive value and median absolute timing error of each recording."""
    matches = stage(matches, "matches")  # they are counted and ranked
    n = reference.groupBy(key).agg(F.count(F.lit(1)).alias("n_ref")).join(detected.groupBy(key).agg(F.count(F.lit(1)).alias("n_det")), key, "full")
    hits = with_medians(matches.groupBy(key).agg(F.count(F.lit(1)).alias("tp")), matches, [key], {"error": F.abs(F.col("det_time") - F.col("ref_time"))})
    tp = F.coalesce("tp", F.lit(0))
    return n.join(hits, key, "left").select(key, tp.alias("tp"), F.when(F.col("n_ref") > 0, tp / F.col("n_ref")).alias("sensitivity"), F.when(F.col("n_det") > 0, tp / F.col("n_det")).alias("ppv"), "error")
