"""Replicates as columns of weights, against loops that repeat rows; with a hot tie, NULLs, unlisted subjects and ranges that are dealt again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plethora.operators import gates, replicates as rp, resampling as rs

SUBJECTS = [f"s{k}" for k in range(6)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    return [(k, r.choice(["a"] * 4 + [None]), r.choice(SUBJECTS + ["unlisted"]), r.choice([1.0] * 3 + [None] + [float(r.randint(0, 60)) for _ in range(6)]), r.choice([r.random(), 0.5])) for k in range(1200)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "i long, g string, s string, v double, w double").repartition(5)


@pytest.fixture(scope="module")
def draws():
    return rs.draw_matrix(len(SUBJECTS), 40)


def repeated(rows, draws, rep):
    return [x for x in rows if x[2] in SUBJECTS for _ in range(draws[SUBJECTS.index(x[2]), rep])]


def test_draws_are_those_of_choice():
    random_, found = np.random.default_rng(rs.SEED), rs.draw_matrix(9, 20)
    for rep in range(20):
        assert np.bincount(random_.choice(9, 9), minlength=9).tolist() == found[:, rep].tolist()
    random_, halves = np.random.default_rng(rs.SEED), rs.half_matrix(9, 20)
    for rep in range(20):
        order = random_.permutation(9).tolist()
        assert sorted(order[:4]) == np.flatnonzero(halves[:, rep]).tolist()


@pytest.mark.parametrize("most", [rp.MOST, 40])
def test_medians_of_all_replicates(table, rows, draws, most):
    weights = rp.drawn(draws, SUBJECTS, "s")
    shares = lambda n, low, high: {"lo": np.where(n > 0, (n - 1) * 0.1, np.nan), "mid": np.where(n > 0, (n - 1) * 0.5, np.nan)}
    got = {(r["g"], r["column"]): r for r in rp.select(table, ["g"], "v", weights, shares, most=most).collect()}
    assert len(got) == 80
    for rep in range(40):
        again = repeated(rows, draws, rep)
        for g in ("a", None):
            own = [x[3] for x in again if x[1] == g and x[3] is not None]
            r = got[(g, rep)]
            assert r["n"] == len(own) and np.allclose([r["lo"], r["mid"]], np.quantile(own, [0.1, 0.5]))


def test_a_replicate_without_rows_has_no_median(spark):
    d = spark.createDataFrame([("s0", 1.0), ("s0", 3.0)], "s string, v double")
    got = {r["column"]: (r["n"], r["median"]) for r in rp.medians(d, [], "v", rp.drawn(np.array([[1, 0, 2]]), ["s0"], "s")).collect()}
    assert got == {0: (2, 2.0), 1: (0, None), 2: (4, 2.0)}
    assert rp.medians(d.limit(0), [], "v", rp.drawn(np.array([[1]]), ["s0"], "s")).collect() == []


@pytest.mark.parametrize("most", [rp.MOST, 30])
def test_all_but_one(table, rows, most):
    found = rp.select(table, [], "v", rp.left_out([*SUBJECTS, "unlisted"], "s"), lambda n, low, high: {"q": (n - 1) * 0.25}, most=most)
    got = {r["column"]: r["q"] for r in found.collect()}
    for k, s in enumerate([*SUBJECTS, "unlisted"]):
        assert got[k] == np.quantile([x[3] for x in rows if x[2] != s and x[3] is not None], 0.25)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_held_out_quantiles_name_their_subjects(table, rows):
    got = {r["fold"]: r["cut"] for r in gates.held_out_quantiles(table, "s", "v", {"cut": 0.5}).collect()}
    assert got == {s: np.quantile([x[3] for x in rows if x[2] != s and x[3] is not None], 0.5) for s in [*SUBJECTS, "unlisted"]}


def test_calibrated_splits(table, rows):
    calib = rs.half_matrix(len(SUBJECTS), 25)
    got = {r["rep"]: r for r in rp.calibrated_splits(table.where("s <> 'unlisted'"), SUBJECTS, "s", "v", "w", calib, 0.5).collect()}
    for rep in range(25):
        inside = [x for x in rows if x[2] in SUBJECTS and calib[SUBJECTS.index(x[2]), rep]]
        held = [x for x in rows if x[2] in SUBJECTS and not calib[SUBJECTS.index(x[2]), rep]]
        cut = sorted((x[3] for x in inside if x[3] is not None), reverse=True)[round(0.5 * len(inside)) - 1]
        shown = [x[4] for x in held if x[3] is not None and x[3] >= cut]
        assert got[rep]["threshold"] == cut and np.isclose(got[rep]["coverage"], len(shown) / len(held)) and np.isclose(got[rep]["md"], np.median(shown))


def ranks(values):
    own = np.sort(values)
    return (np.searchsorted(own, values, "left") + np.searchsorted(own, values, "right") + 1) / 2


def test_rank_correlation_of_replicates(table, rows, draws):
    got = {(r["g"], r["column"]): r for r in rp.spearman_drawn(table, ["g"], "v", "w", draws, SUBJECTS, "s").collect()}
    for rep in range(0, 40, 7):
        for g in ("a", None):
            own = np.array([(x[3], x[4]) for x in repeated(rows, draws, rep) if x[1] == g and x[3] is not None])
            r = got[(g, rep)]
            assert r["n"] == len(own) and np.isclose(r["spearman"], np.corrcoef(ranks(own[:, 0]), ranks(own[:, 1]))[0, 1])


@pytest.mark.parametrize("cells", [rp.CELLS, 400])
def test_best_rows_of_each_replicate(table, rows, draws, cells, monkeypatch):
    monkeypatch.setattr(rp, "CELLS", cells)
    shares, known = [0.1, 0.5, 1.0], table.where("v IS NOT NULL")
    ranking = rp.below_vectors(known.select("i", "g", "s", "v", "w"), ["g"], {"w": False, "i": True}, SUBJECTS, "s")
    weights = rp.best_of(draws, SUBJECTS, "s", shares)
    risk = {(r["g"], r["column"]): r for r in rp.medians(ranking, ["g"], "v", weights, classes=["s", "_below", "_total"]).collect()}
    rho = {(r["g"], r["column"]): r for r in rp.spearman_of_best(ranking, ["g"], "v", "i", weights).collect()}
    for rep in range(0, 40, 9):
        for g in ("a", None):
            own = sorted((x for x in repeated(rows, draws, rep) if x[1] == g and x[3] is not None), key=lambda x: (-x[4], x[0]))
            for k, share in enumerate(shares):
                best = own[: round(share * len(own))]
                r, t = risk[(g, rep * 3 + k)], rho[(g, rep * 3 + k)]
                assert r["n"] == t["n"] == len(best) and r["median"] == np.median([x[3] for x in best])
                assert np.isclose(t["spearman"], np.corrcoef(ranks(np.array([x[3] for x in best])), ranks(np.array([x[0] for x in best])))[0, 1])


def test_a_value_of_a_third_of_rows_is_a_row_a_range(spark):
    """Order statistics: rows of one value are counted before ranges are made."""
    from plethora.operators import order_stats

    d = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(-1.0)).otherwise(F.col("id").cast("double")).alias("v"))
    assert order_stats.quantiles(d, [], "v", {"q": 0.5}).first()["q"] == np.quantile([-1.0 if k % 3 == 0 else k for k in range(30000)], 0.5)
    known = order_stats.by_range(d.groupBy("v").count(), [], [F.asc("v")])
    sizes = [r["count"] for r in known.groupBy("_part").agg(F.count(F.lit(1)).alias("count")).collect()]
    assert len(sizes) > 1 and max(sizes) < 20001 / 2
