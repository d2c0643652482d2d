"""One long recording over several tasks: filters, frames, as-of joins and matches against plain versions, with a key that holds half of the rows."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plethora.functions import dsp
from plethora.operators import intervals, slices
from plethora.operators.asof import asof
from plethora.operators.matching import chained, matched_pairs, nearest_match


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(4)
    rows = [(k, t, r.gauss(50, 10)) for k, n in (("hot", 1000), ("b", 130), ("c", 1), (None, 64)) for t in range(n)]
    return spark.createDataFrame(rows, "k string, t long, x double").repartition(5), rows


def by_key(rows):
    found = {}
    for k, t, x in rows:
        found.setdefault(k, []).append(x)
    return found


@pytest.mark.parametrize("length", [64, 5, 10_000])
def test_filters_in_slices(samples, length):
    df, rows = samples
    sections = [dsp.butterworth2(100.0, 0.5, "high"), dsp.butterworth2(100.0, 3.5, "low")]
    got = {}
    for r in slices.filtered(df, ["k"], ["t"], "x", sections, length).collect():
        got.setdefault(r["k"], {})[r["i"]] = r["filtered"]
    for k, x in by_key(rows).items():
        want = dsp.cascade(np.array(x), sections, [0.0] * 4)
        assert np.allclose([got[k][i] for i in range(len(x))], want, atol=1e-9)


def test_frames_in_slices(samples):
    df, rows = samples
    d, w = slices.haloed(df, ["k"], [F.asc("t")], 9, 5, 16)
    d = slices.own_rows(d.withColumns({"mean": F.avg("x").over(w.rowsBetween(-9, 0)), "med": intervals.centred_median("x", w), "ahead": F.lead("x", 3).over(w)}))
    got = {(r["k"], r["t"]): r for r in d.collect()}
    assert len(got) == len(rows) and d.columns[:3] == ["k", "t", "x"]
    for k, x in by_key(rows).items():
        padded = [x[0]] * 5 + x + [x[-1]] * 5
        for t in range(len(x)):
            r = got[(k, t)]
            assert r["i"] == t and np.isclose(r["mean"], np.mean(x[max(0, t - 9) : t + 1])) and r["med"] == sorted(padded[t : t + 11])[5]
            assert r["ahead"] == (x[t + 3] if t + 3 < len(x) else None)


def test_a_hot_recording_lies_in_several_ranges(samples):
    from plethora.operators.order_stats import by_range

    df, _ = samples
    assert by_range(df, ["k"], [F.asc("t")]).where("k = 'hot'").select("_part").distinct().count() > 1


@pytest.mark.parametrize("inclusive", [False, True])
def test_asof_with_a_hot_key(spark, inclusive):
    r = random.Random(9)
    left = [("hot" if r.random() < 0.6 else r.choice("abc"), r.randint(0, 400), n) for n in range(900)] + [(None, 5, 1000), ("only left", 3, 1001)]
    right = [("hot" if r.random() < 0.6 else r.choice("abc"), r.randint(0, 400), r.random()) for _ in range(300)] + [(None, 4, 0.5), ("only right", 3, 0.1)]
    got = asof(spark.createDataFrame(left, "k string, us long, n int"), spark.createDataFrame(right, "k string, us long, v double"), "k", "us", inclusive, take="v", out="v_before").collect()
    assert len(got) == len(left)
    for x in got:
        own = sorted((t, v) for k, t, v in right if k == x["k"] and (t <= x["us"] if inclusive else t < x["us"]))
        assert x["v_before"] == (own[-1][1] if own else None)  # of equal times the greatest value


def test_matches_by_chains(spark):
    r = random.Random(11)
    for group in (1, 40, 20_000):
        det, ref = ([(r.choice(["hot"] * 3 + ["b"]), round(r.uniform(0, 300), 1)) for _ in range(400)] for _ in range(2))
        left, right = spark.createDataFrame(det + [(None, 1.0), ("x", None)], "k string, t double"), spark.createDataFrame(ref + [("only ref", 2.0)], "k string, t double")
        got = sorted(map(tuple, nearest_match(left, right, "k", "t", 0.4, group).collect()))
        want = []
        for k in ("hot", "b"):
            d, w = (np.sort([t for key, t in side if key == k]) for side in (det, ref))
            want += [(k, w[i], d[j]) for i, j in matched_pairs(d, w, 0.4)]
        assert got == sorted(want)


def test_chains_are_whole(spark):
    r = random.Random(2)
    times = sorted(round(r.uniform(0, 500), 2) for _ in range(600))
    d = chained(spark.createDataFrame([("k", t) for t in times], "k string, t double"), "k", "t", 0.5, 50)
    group = {}
    for x in d.collect():
        group.setdefault(x["t"], set()).add(x["_group"])
    assert all(len(g) == 1 for g in group.values()) and len({min(g) for g in group.values()}) > 3
    for a, b in zip(times, times[1:]):
        if b - a <= 0.5:
            assert group[a] == group[b]
    assert bisect.bisect(times, 500) == 600


def test_blocks_side_by_side_are_filtered_as_one_by_one():
    x, sections = np.random.default_rng(3).normal(size=(7, 40)), [dsp.butterworth2(100.0, 0.5, "high"), dsp.butterworth2(100.0, 3.5, "low")]
    state = np.random.default_rng(4).normal(size=(7, 4))
    one = [list(s) for s in state.tolist()]
    want = [dsp.cascade(row, sections, registers) for row, registers in zip(x, one)]
    assert (dsp.cascades(x, sections, state) == np.array(want)).all() and (state == np.array(one)).all()


def test_filters_of_many_short_recordings_run_in_few_calls(spark):
    from pyspark.sql.functions import col

    d = slices.filtered(spark.range(3000).select((col("id") % 900).alias("k"), "id", (col("id") % 7).cast("double").alias("x")), ["k"], ["id"], "x", [dsp.butterworth2(100.0, 0.5, "high")], 3)
    plan = d._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapCoGroups" not in plan and "FlatMapGroups" not in plan.split("MapInPandas")[0]
    assert d.count() == 3000
