"""Beats of every recording under every variant, against a loop; each recording is shuffled once."""

import numpy as np

from plethora.functions import pulse
from plethora.operators import replay
from plethora.plans import QUERIES
from tests.conftest import SF
from tests.test_kernel_queries import recordings


def beats_of(x, name, fs):
    gate, systolic, flip = replay.VARIANTS[name]
    return pulse.replay(2 * np.median(x) - x if flip else x, pulse.Settings(fs=fs, gate=gate, systolic=systolic))["beats"]


def test_session_beats_cover_every_variant(spark):
    d = QUERIES["session_beats_kernel"].run(spark, SF)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {(rec, name, b["packet"]): (round(b["dt_ms"], 6), b["accepted"]) for rec, rows in recordings(spark).items() for name in replay.VARIANTS for b in beats_of(np.array([v for _, _, v in rows]), name, 4.0)}
    rows = d.collect()
    assert {(r["rec"], r["variant"], r["packet"]): (r["dt_ms"], r["accepted"]) for r in rows} == want and len(rows) == len(want)
    assert {r["variant"] for r in rows} == set(replay.VARIANTS)


def test_variants_of_a_pulse_with_its_quality(spark):
    """At a rate that the pulse's band fits in, some beats are accepted; those behind a gate know what it saw."""
    rows = [(k, i, float(50 + 0.5 * np.sin(2 * np.pi * i * (1 + k / 10) / 25) + 0.05 * (i % 3))) for k in range(3) for i in range(400 + 40 * k)]
    d = replay.variant_beats(spark.createDataFrame(rows, "k long, i int, x double").repartition(3), ["k"], "i", "x", 25.0)
    got = {}
    for r in d.collect():
        got.setdefault((r.k, r.variant), []).append((r.packet, r.dt_ms, r.accepted, r.sqi))
    for k in range(3):
        for name in replay.VARIANTS:
            want = [(b["packet"], b["dt_ms"], b["accepted"], b["sqi"]) for b in beats_of(np.array([x for q, _, x in rows if q == k]), name, 25.0)]
            assert sorted(got[(k, name)]) == want
    assert all(any(b[2] for b in got[(0, name)]) for name in replay.VARIANTS)
    assert all((b[3] is None) == (replay.VARIANTS[name][0] is None) for (_, name), beats in got.items() for b in beats)
