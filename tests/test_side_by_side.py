"""Recordings that are filtered side by side keep their bits, and what a group makes of its beats is what joins make of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plethora.functions import dsp
from plethora.operators.matching import figures_of, match_summary, nearest_match
from plethora.plans import QUERIES
from plethora.sources import synthetic as sy
from tests.conftest import SF


@pytest.mark.parametrize("sections", [dsp.butterworth_band(128.0, 5.0, 20.0), [dsp.butterworth2(100.0, 3.5, "low"), dsp.butterworth2(100.0, 0.5, "high")]])
def test_many_signals_are_filtered_as_each_alone(sections):
    r = np.random.default_rng(3)
    signals = [r.normal(size=n).cumsum() for n in (0, 1, 2, 3, 9, 16, 17, 300, 310, 400, 400, 555, 640, 641, 1300, 4000)]
    for some in (signals, signals[::-1], signals[8:13], signals[:1], []):
        for x, y in zip(some, dsp.zero_phases(some, sections, 15), strict=True):
            assert np.array_equal(y, dsp.zero_phase(x, sections, 15))


def test_peaks_of_many_signals():
    r = np.random.default_rng(5)
    ecgs = [sy.ecg(r.normal(0.8, 0.05, n), 128.0, r)[0] for n in (1, 4, 20, 21, 22, 23, 24, 25)] + [np.zeros(2), np.zeros(500)]
    y = [dsp.band_pass(x - np.median(x), 128.0, 5.0, 20.0) if len(x) > 2 else x for x in ecgs]
    for x, t, own in zip(ecgs, dsp.r_peaks_of(ecgs, 128.0), y, strict=True):
        assert np.array_equal(t, dsp._peaks_in(own, 128.0, 0.3) if len(x) > 2 else np.zeros(0))


def test_figures_of_a_group_are_those_of_the_joins(spark):
    r = np.random.default_rng(8)
    rows = [(k, ref, float(np.round(t, 3))) for k, n in ((1, 40), (2, 1), (3, 7)) for ref in (True, False) for t in r.random(n) * 900] + [(4, True, 5.0)]
    df = spark.createDataFrame(rows, "k long, ref boolean, t double")
    found, wanted = df.where("NOT ref").drop("ref"), df.where("ref").drop("ref")
    want = {x["k"]: x for x in match_summary(nearest_match(found, wanted, "k", "t", 12.0), found, wanted, "k").collect()}
    assert len(want) == 4
    for k, x in want.items():
        of = lambda ref: np.array([t for q, is_ref, t in rows if q == k and is_ref == ref])
        assert {c: [x[c]] for c in ("tp", "sensitivity", "ppv", "error")} == figures_of(of(False), of(True), 12.0)


@pytest.mark.parametrize("together", [1, 70, 10_000])
def test_recordings_gathered_are_those_one_by_one(spark, together):
    d = spark.range(900).select((F.col("id") % 13).alias("k"), F.col("id").alias("at"), (F.lit(700.0) + F.col("id") % 100).alias("rr"))
    shape = lambda s, beats: {"n": [len(s["ecg"])], "top": [s["ecg"].max()], "last": [beats[-1]]}
    fields = "n long, top double, last double"
    want = sorted(map(tuple, sy.beat_signals(d, "k", ["at"], "rr", 20.0, noise=0.1, then=shape, fields=fields).collect()))
    many = lambda s, beats: [shape(*x) for x in zip(s, beats)]
    assert sorted(map(tuple, sy.beat_signals(d, "k", ["at"], "rr", 20.0, noise=0.1, then=many, fields=fields, parts=("ecg",), together=together).collect())) == want


def test_parts_of_the_signals_keep_their_draws(spark):
    d = spark.range(90).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), (F.lit(700.0) + F.col("id")).alias("rr"))
    sums = lambda s, beats: {"light": [float(s["light"].sum())]}
    whole, part = (sorted(map(tuple, sy.beat_signals(d, "k", ["at"], "rr", 20.0, noise=0.1, shaken=1.5, then=sums, fields="light double", **more).collect())) for more in ({}, {"parts": ("light",)}))
    assert whole == part


def test_detections_run_once(spark):
    """One shuffle of the intervals; the detector is not run again for bounds, counts or joins."""
    plan = QUERIES["r_detector_validation"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan
