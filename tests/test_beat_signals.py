"""Signals made from intervals: a task goes through its recordings one after the other, and figures of intervals are those of arrays."""

import math

import numpy as np
from pyspark.sql import functions as F

from plethora.functions import pulse
from plethora.sources import synthetic as sy


def test_recordings_take_no_call_each(spark):
    """Samples and what is made of them, in the order of the intervals; what is not a number is NULL."""
    d = spark.range(60).select((F.col("id") % 3).alias("k"), (60 - F.col("id")).alias("at"), (F.lit(800.0) + F.col("id")).alias("rr"))
    samples = sy.beat_signals(d, "k", ["at"], "rr", 20.0)
    made = sy.beat_signals(d, "k", ["at"], "rr", 20.0, then=lambda s, beats: {"n": np.array([len(s["i"])]), "last": [beats[-1]], "none": np.array([np.nan])}, fields="n long, last double, none double")
    for frame in (samples, made):
        assert "FlatMapGroups" not in frame._jdf.queryExecution().toString()
    sizes, got = {r["k"]: r["count"] for r in samples.groupBy("k").count().collect()}, made.collect()
    assert len(got) == 3 and all(r["none"] is None and r["n"] == sizes[r["k"]] for r in got)
    first = {k: [800.0 + i for i in range(60) if i % 3 == k][::-1] for k in range(3)}
    assert all(r["last"] == (np.cumsum(first[r["k"]]) / 1000)[-1] for r in got)
    assert [r["i"] for r in samples.where("k = 1").orderBy("i").collect()] == list(range(sizes[1]))


def test_figures_of_intervals_keep_their_bits():
    r = np.random.default_rng(4)
    for n in range(61):
        x = (r.random(n) * 900 + 300).tolist()
        d = np.diff(x)
        assert pulse.mean_square_successive(x) == (math.sqrt(pulse.in_order(d * d) / len(d)) if n > 1 else 0.0)
        assert pulse.rate(x, 10) == (60000.0 / float(np.median(x[-10:])) if n >= 3 else None)
        if n >= 3:
            mean = pulse.mean_of(np.array(x))
            assert pulse.regularity(x) == min(1.0, max(0.0, 1.0 - 0.5 * pulse.spread_of(np.array(x), mean) / mean))
