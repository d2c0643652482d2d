"""Queries of kernels against loops over the recordings, and what detection and models must reach."""

import math

import numpy as np

from plethora.functions import dsp, pulse, stress
from plethora.operators.replay import VARIANTS
from plethora.plans import QUERIES
from plethora.plans import kernel_queries as kq
from tests.conftest import SF


def recordings(spark):
    found = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "value").collect():
        found.setdefault(r["user_id"], []).append((r["ts"], r["event_id"], r["value"]))
    return {rec: sorted(rows) for rec, rows in found.items()}


def test_session_replay_against_a_loop(spark):
    want = {}
    for rec, rows in recordings(spark).items():
        x = np.array([v for _, _, v in rows])
        for name, (gate, systolic, flip) in VARIANTS.items():
            for t in pulse.replay(2 * np.median(x) - x if flip else x, pulse.Settings(fs=4.0, gate=gate, systolic=systolic))["ticks"]:
                want[(rec, name, t["sample"])] = (round(t["sqi"], 6), round(t["rmssd"], 6), None if t["hr"] is None else round(t["hr"], 6), t["n_intervals"], t["reject"])
    got = {(r["rec"], r["variant"], r["sample"]): (r["sqi"], r["rmssd"], r["hr"], r["n_intervals"], r["reject"]) for r in QUERIES["session_replay_kernel"].run(spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, (sqi, rmssd, hr, n, reject) in want.items():
        assert abs(got[k][0] - sqi) < 2e-6 and abs(got[k][1] - rmssd) < 2e-6 and got[k][3:] == (n, reject) and (got[k][2] is None) == (hr is None) and abs((got[k][2] or 0) - (hr or 0)) < 2e-6


def test_stress_against_a_loop(spark):
    want = {}
    for rec, rows in recordings(spark).items():
        hr = [60 + v / 5 if e % 17 else None for _, e, v in rows]
        open_ = [k > 0 and rows[k - 1][2] >= 5 for k in range(len(rows))]
        for k, tick in enumerate(stress.simulate(hr, [40 - v / 10 for _, _, v in rows], open_)):
            want[(rec, k)] = tick
    assert {(r["rec"], r["i"]): (r["score"], r["level"]) for r in QUERIES["ema_hysteresis_stress"].run(spark, SF).collect()} == want


def test_sessions_start_with_their_own_baseline(spark):
    rows = QUERIES["stress_sessions"].run(spark, SF).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["i"]):
        by.setdefault((r["rec"], r["session"]), []).append((r["score"], r["level"]))
    assert all(x == (0, 0) for ticks in by.values() for x in ticks[: stress.BASELINE - 1]) and len(rows) == 1000


def test_beats_band_and_resampling_of_one_recording(spark):
    rec, rows = max(recordings(spark).items(), key=lambda x: len(x[1]))
    x = np.array([v for _, _, v in rows])
    beats = pulse.replay(x, pulse.Settings(fs=4.0, gate=None))["beats"]
    got = [(r["packet"], r["accepted"]) for r in QUERIES["session_beats_kernel"].run(spark, SF).where(f"rec = {rec} AND variant = 'off'").orderBy("packet").collect()]
    assert got == [(b["packet"], b["accepted"]) for b in beats]


def test_detector_and_features_of_all_recordings(spark):
    r = QUERIES["r_detector_validation"].run(spark, SF).collect()
    assert len(r) == len(recordings(spark)) and all(x["sensitivity"] > 0.99 and x["ppv"] > 0.99 and x["error_ms"] < 4 for x in r)
    shape = QUERIES["waveform_polarity"].run(spark, SF).collect()
    assert len(shape) == len(r) and all(abs(x["min_after_ms"] - 120) < 10 and x["rise_over_fall"] > 0 for x in shape)
    f = QUERIES["feature_rows"].run(spark, SF).collect()
    assert len(f) >= len(r) // 2 and all(x["tmpl_corr_mean"] > 0.9 and 0 <= x["reject_frac"] <= 1 and x["acc_sd"] > 0 for x in f)
    rate = QUERIES["spectral_rate_check"].run(spark, SF).collect()
    assert rate and all(x["md_error"] < 10 for x in rate)


def test_filters_have_their_closed_forms():
    s = dsp.butterworth_band(128.0, 5.0, 20.0)
    gain = lambda f: abs(dsp.response(s, 128.0, f))
    assert abs(gain(5.0) - math.sqrt(0.5)) < 1e-9 and abs(gain(20.0) - math.sqrt(0.5)) < 1e-9 and gain(0.0) < 1e-9 and len(s) == 2
    warp = lambda f: math.tan(math.pi * f / 128)
    for f in (2.0, 7.0, 30.0, 50.0):  # |H|^2 = 1 / (1 + x^4), x the prototype's frequency
        x = (warp(f) ** 2 - warp(5.0) * warp(20.0)) / (warp(f) * (warp(20.0) - warp(5.0)))
        assert abs(gain(f) - 1 / math.sqrt(1 + x**4)) < 1e-9
    taps = dsp.low_pass_taps(0.5 / 32, 320, np.kaiser(641, 5.0))
    assert abs(taps.sum() - 1) < 1e-12 and np.allclose(taps, taps[::-1])
    impulse = np.zeros(200)
    impulse[100] = 1
    y = dsp.resample(impulse, 25, 32)
    want = [25 * taps[m * 32 - 2500 + 320] if 0 <= m * 32 - 2500 + 320 <= 640 else 0.0 for m in range(len(y))]
    assert len(y) == math.ceil(200 * 25 / 32) and np.allclose(y, want) and np.allclose(dsp.resample(impulse, 50, 64), y)


def test_methods_are_evaluated_on_all_rows(spark):
    """The areas of the rankers and of the oracle, against plain medians of prefixes."""
    rows = [r.asDict() for r in kq._windows_of_orders(spark, SF).collect()]
    got = {r["method"]: r for r in QUERIES["method_evaluation"].run(spark, SF).collect()}
    assert set(got) == {"f1", "f2", "f3", "logistic", "gbm", "gbm_no_f1", "gbm_f3", "oracle"}
    ae = sorted(r["ae"] for r in rows)
    areas = [np.median(ae[: round(c * len(ae))]) for c in np.arange(0.10, 1.0001, 0.05).round(2)]
    assert abs(got["oracle"]["aurc"] - np.mean(areas)) < 0.01 and got["oracle"]["gap_closed"] == 1
    assert got["gbm"]["gap_closed"] > got["gbm_no_f1"]["gap_closed"] and got["gbm"]["auroc"] > 0.9
    best = sorted(rows, key=lambda r: (r["f1"], r["o_orderkey"]))
    areas = [np.median([r["ae"] for r in best[: round(c * len(best))]]) for c in np.arange(0.10, 1.0001, 0.05).round(2)]
    assert abs(got["f1"]["aurc"] - np.mean(areas)) < 0.01
