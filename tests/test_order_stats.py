"""Order statistics that spread over ranges, against numpy, with a group that holds most rows, ties, NULLs and NULL keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plethora.operators import matching, metrics, order_stats, ranking


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    found = [(k, r.choice(["a"] * 8 + ["b", None]), r.choice([None] + [float(r.randint(0, 40)) for _ in range(9)]), r.random()) for k in range(1500)]
    return [*found, (1500, "only nulls", None, 0.5), (1501, "one", 3.0, 0.1)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "i long, g string, v double, s double").repartition(6)


def test_quantiles(table, rows):
    got = {r["g"]: r for r in order_stats.quantiles(table, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.975}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        own = [v for _, k, v, _ in rows if k == g and v is not None]
        assert r["n"] == len(own) and np.allclose([r["lo"], r["mid"], r["hi"]], np.quantile(own, [0.1, 0.5, 0.975]))
    whole = order_stats.quantiles(table, [], "v", {"mid": 0.5}).first()
    assert whole["mid"] == np.median([v for _, _, v, _ in rows if v is not None])


def test_weights_stand_for_rows(table):
    counted = table.groupBy("g", "v").agg(F.count(F.lit(1)).alias("m"))
    plain, weighted = order_stats.quantiles(table, ["g"], "v", {"q": 0.3}), order_stats.quantiles(counted, ["g"], "v", {"q": 0.3}, "m")
    key = lambda r: str(r["g"])
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, weighted.collect()), key=str) and key
    ranks = {(r["g"], r["v"]): r["rank"] for r in order_stats.average_ranks(counted.where("v IS NOT NULL"), ["g"], "v", "m").collect()}
    own = sorted(r["v"] for r in table.where("g = 'a' AND v IS NOT NULL").collect())
    assert all(abs(ranks[("a", v)] - np.mean([k + 1 for k, x in enumerate(own) if x == v])) < 1e-9 for v in set(own))


def test_risk_coverage_against_a_loop(table, rows):
    grid = ranking.coverage_grid(0.05, 1.0, 0.05)
    known = table.where("v IS NOT NULL")
    got = {(r["g"], r["c"]): (r["k"], r["risk"]) for r in ranking.risk_coverage(known, ["g"], "s", "v", grid, ["i"]).collect()}
    want = {}
    for g in {k for _, k, _, _ in rows}:
        own = [v for _, k, v, s in sorted(rows, key=lambda x: (-x[3], x[0])) if k == g and v is not None]
        for c in grid:
            k = round(c * len(own))
            if 5 <= k <= len(own):
                want[(g, c)] = (k, float(np.median(own[:k])))
    assert got == want


def test_conformal_and_threshold(spark, table, rows):
    got = {r["g"]: r["q"] for r in ranking.conformal_quantile(table.where("g <> 'only nulls'"), ["g"], "v", 0.1).collect()}
    own = [v for _, k, v, _ in rows if k == "a" and v is not None]
    assert got["a"] == ranking.conformal_rank_value(own, 0.1) and got["one"] == float("inf")
    t = {r["g"]: r["threshold"] for r in ranking.threshold_for_share(table, ["g"], "v", 0.5).collect()}
    every = [v for _, k, v, _ in rows if k == "a"]
    assert t["a"] == sorted(own, reverse=True)[round(0.5 * len(every)) - 1] and t["only nulls"] in (float("-inf"), float("inf"))
    with pytest.raises(Exception, match="at least one"):
        ranking.conformal_quantile(table.where("g = 'only nulls'"), ["g"], "v", 0.1).collect()


def test_spearman_of_ties(spark, table):
    both = table.where("g = 'a' AND v IS NOT NULL").toPandas()
    rank = lambda x: np.array([np.mean([k + 1 for k, y in enumerate(sorted(x)) if y == v]) for v in x])
    want = np.corrcoef(rank(both["v"].tolist()), rank(both["s"].tolist()))[0, 1]
    got = {r["g"]: r for r in metrics.spearman(table, ["g"], "v", "s").collect()}
    assert abs(got["a"]["spearman"] - want) < 1e-9 and got["one"]["spearman"] is None


def test_matched_pairs_against_the_rule():
    r = random.Random(4)
    for _ in range(200):
        d, w = (np.sort([round(r.uniform(0, 20), 1) for _ in range(r.randint(0, 25))]) for _ in range(2))
        taken, want = set(), []
        for k, t in enumerate(w):
            right = sum(x < t for x in d)
            free = sorted((abs(d[j] - t), j) for j in (right - 1, right) if 0 <= j < len(d) and j not in taken and abs(d[j] - t) <= 1.5)
            if free:
                taken.add(free[0][1])
                want.append((k, free[0][1]))
        assert matching.matched_pairs(d, w, 1.5) == want
