"""Quantiles of a table that is read again instead of dealt, and intervals whose rows are predicted once per fit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plethora.operators import models as mo
from plethora.operators import order_stats as os

AT = lambda n: {"q": (n - 1) * 0.37, "last": n - 1, "none": F.when(n > 100_000, n), "k": F.when(n > 3, F.ceil((n + 1) * 0.9) - 1)}


def _rows():
    r = np.random.default_rng(21)
    d = [("even", float(v), 1) for v in r.random(3000)] + [("far", float(v), int(m)) for v, m in zip([*np.round(r.normal(size=900), 1), 1e200, -1e300], r.integers(1, 9, 902))]
    d += [("one", 2.5, 7), ("one", None, 9), ("none", None, 1), ("same", 1.0, 2), ("same", 1.0, 3)]
    return d + [("endless", float(v), 2) for v in [*r.random(50), math.inf, -math.inf]]


@pytest.mark.parametrize("most", [200_000, 0])
def test_a_table_read_again_gives_what_ranges_give(spark, monkeypatch, most):
    monkeypatch.setattr(os, "SMALL", most)
    df = spark.createDataFrame(_rows(), "g string, v double, m long").repartition(3)
    got, want = ({r["g"]: r for r in pick(df, ["g"], "v", AT, "m").collect()} for pick in (os.picked_in_table, os.picked))
    assert set(got) == set(want) == {"even", "far", "one", "same", "endless"}
    assert all(got[g][c] == want[g][c] for g in got for c in ("n", "q", "last", "none", "k"))
    every = [v for _, v, m in _rows() for _ in range(m) if v is not None]
    assert os.picked_in_table(df, [], "v", lambda n: {"mid": F.floor(n / 2)}, "m").collect()[0]["mid"] == sorted(every)[len(every) // 2]


def test_few_rows_are_left_to_sort(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.rand(7).alias("v"))
    left = os.thinned(df, ["g"], "v", lambda n: {"mid": (n - 1) * 0.5})
    assert left.count() <= 2 * (os.PLACES + 200) and left.agg(F.sum("_w")).first()[0] == 200_000


def test_rows_are_predicted_once_per_fit(spark, monkeypatch):
    r = np.random.default_rng(22)
    d = [(int(k % 5), float(k % 9), float(x)) for k, x in enumerate(np.abs(r.normal(size=1500)))]
    df = mo.alike(spark.createDataFrame([(g, a, x, round(x + a, 3)) for g, a, x in d], "g long, a double, x double, y double"), "g", "a", "x", "y")
    table = mo.roles(spark, mo.conformal_roles(list(range(5)), 10))
    plain = mo.conformal(mo.assigned(df, "g", table), ["a", "x"], "y", trees=5, keep=["a"])
    sent, predicted = [], mo.boosted_errors
    monkeypatch.setattr(mo, "boosted_errors", lambda rows, *args: sent.append(rows.count()) or predicted(rows, *args))
    once = mo.conformal(df, ["a", "x"], "y", trees=5, keep=["a"], table=table, group="g")
    fits = {r["fit"] for r in table.collect()}
    assert sent == [df.count() * len(fits) * 2 // 5]  # two of five groups don't train
    kept = ("split", "kind", "a", "y", "half", "covered", "repeats", "times")
    key = lambda x: (x["split"], x["kind"], x["a"], x["y"], x["half"])
    a, b = (sorted(t.select(*kept).collect(), key=key) for t in (plain, once))
    assert len(a) == len(b) and all(x[c] == y[c] for x, y in zip(a, b) for c in kept if c != "half") and np.allclose([x["half"] for x in a], [x["half"] for x in b])


def test_bins_in_runs_and_gaps_give_the_plain_sums():
    """Cells are gone through in no order and by comparing whole columns; histograms are those of each node's cells."""
    from plethora.functions import boosting

    r = np.random.default_rng(23)
    codes = [np.sort(r.integers(0, 6, 4000)), r.integers(0, 4, 4000)]
    count, rest, edges = r.integers(1, 4, 4000).astype(float), r.normal(size=4000), [np.arange(4.0), np.arange(2.0)]
    model = boosting.fit_coded(codes, count, rest + codes[0], edges, 4, least=1)
    left, sizes, every = rest + codes[0] - model["base"] * count, [5, 3], np.stack(codes, 1)
    for t in range(4):
        leaf = boosting.nodes_of(model, t, 3, every, sizes)
        total, n = np.bincount(leaf, left, 8), np.bincount(leaf, count, 8)
        assert (model["cover"][t, 7:] == n).all() and np.allclose(model["value"][t], np.where(n > 0, 0.05 * total / np.maximum(n, 1), 0.0))
        left -= count * model["value"][t][leaf]
