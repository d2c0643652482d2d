"""Kernels go through many short recordings in one call, wherever batches end, and give what one call per recording gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plethora.functions import pulse, stress
from plethora.operators import replay


@pytest.fixture()
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stress_by_recording(short_batches):
    r = np.random.default_rng(12)
    rows = [(k, i, None if r.random() < 0.1 else float(60 + r.normal() * 9), float(40 - r.normal() * 9), None if r.random() < 0.05 else bool(r.random() < 0.9)) for k, n in ((None, 90), (1, 70), (2**60 + 1, 1), (3, 400), (4, 50)) for i in range(n)]
    df = short_batches.createDataFrame(rows, "k long, i int, hr double, hrv double, gate boolean").repartition(3)
    d = replay.stress_scores(df, ["k"], "i", "hr", "hrv", "gate")
    assert "MapInArrow" in d._jdf.queryExecution().toString() and d.schema["i"].dataType.simpleString() == "int"
    got = {(x.k, x.i): (x.score, x.level) for x in d.collect()}
    for k in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == k]
        want = stress.simulate([x[2] for x in own], [x[3] for x in own], [bool(x[4]) for x in own])
        assert [got[(k, i)] for i in range(len(own))] == want
    assert len(got) == len(rows)


def test_beats_by_recording_and_variant(short_batches):
    rows = [(k, i, 50 + 9 * np.sin(2 * np.pi * i * (1 + k / 10) / 25) + i % 3) for k in range(5) for i in range(180 + 40 * k)]
    df = short_batches.createDataFrame([(k, i, float(x)) for k, i, x in rows], "k long, i int, x double")
    d = replay.session_beats(replay.with_variants(df.withColumn("fs", F.lit(25.0)), ["off", "gate_0.2", "inverted"]), ["k", "variant"], "i", "x")
    assert "MapInArrow" in d._jdf.queryExecution().toString()
    got = {}
    for x in d.collect():
        got.setdefault((x.k, x.variant), []).append((x.packet, x.dt_ms, x.accepted, x.sqi))
    for k in range(5):
        x = np.array([v for q, _, v in rows if q == k])
        for name in ("off", "gate_0.2", "inverted"):
            gate, systolic, flip = replay.VARIANTS[name]
            found = pulse.replay(2 * np.median(x) - x if flip else x, pulse.Settings(fs=25.0, gate=gate, systolic=systolic))["beats"]
            assert sorted(got.get((k, name), []), key=lambda b: b[0]) == [(b["packet"], b["dt_ms"], b["accepted"], b["sqi"]) for b in found]
    assert got


def test_matches_of_many_recordings_run_in_few_calls(short_batches):
    from plethora.operators.matching import nearest_match

    det, ref = (short_batches.range(400).select((F.col("id") % 90).alias("k"), (F.col("id") * 10 + shift).alias("t")) for shift in (0, 2))
    d = nearest_match(det, ref, "k", "t", 5.0)
    assert "MapInArrow" in d._jdf.queryExecution().toString()
    assert sorted(map(tuple, d.collect())) == sorted((k % 90, k * 10 + 2, k * 10) for k in range(400))
