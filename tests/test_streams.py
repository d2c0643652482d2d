"""Stateful streams: late rows, negative orders, resets, and gaps in a centred median."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from plethora.functions import pulse, stress
from plethora.operators.intervals import centred_median
from plethora.plans import QUERIES
from plethora.sources.shared import delete, fresh_path
from plethora.streaming import streams as st
from tests.conftest import SF


def test_stress_stream_against_a_loop_with_resets(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "value", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us")).collect():
        rows.setdefault(r["user_id"], []).append((r["us"], r["event_id"], r["value"]))
    want = {}
    for rec, own in rows.items():
        state = stress.start()
        for us, event, v in sorted(own):
            state = stress.start() if event % 100 == 0 else state
            want[(rec, us)] = stress.step(state, 60 + v / 5, 40 - v / 10, v >= 2)
    got = {(r["rec"], r["us"]): (r["score"], r["level"]) for r in QUERIES["stream_stress"].run(spark, SF).collect()}
    assert got == want


def test_late_rows_and_negative_orders(spark):
    """Two files, one a batch: the second repeats rows of the first, which are late."""
    x = np.random.default_rng(2).random(80) * 10 + 100
    path = fresh_path(spark, "stream_in")
    for low, high in ((0, 50), (40, 80)):
        spark.createDataFrame([("r", k - 60, float(x[k])) for k in range(low, high)], "rec string, o long, x double").coalesce(1).write.mode("append").parquet(path)
    s = st.read_table(spark, path, per_trigger=1)
    got = st.run_to_table(st.pulse_ticks(s, "rec", "o", "x", pulse.Settings(fs=4.0), idle=None), "append").orderBy("sample").collect()
    want = pulse.replay(x, pulse.Settings(fs=4.0))["ticks"]
    assert [r["sample"] for r in got] == [t["sample"] for t in want] and all(abs(r["sqi"] - t["sqi"]) < 1e-12 for r, t in zip(got, want))


def test_gaps_do_not_shift_a_centred_median(spark):
    values = [1.0, None, 5.0, 2.0, None, None, 9.0, 4.0, 7.0, None]
    d = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "g int, i int, v double")
    got = [r["m"] for r in d.withColumn("m", centred_median("v", Window.partitionBy("g").orderBy("i"), 2)).orderBy("i").collect()]
    for k in range(10):
        near = [values[min(max(j, 0), 9)] for j in range(k - 2, k + 3)]
        known = sorted(v for v in near if v is not None)
        assert got[k] == (known[len(known) // 2] if known else None)


def test_a_stopped_stream_goes_on_from_its_checkpoint(spark):
    """The first run ends after some files; a second one, of new objects, takes up typed states and late counts."""
    x = np.random.default_rng(5).random(240) * 10 + 100
    source, base = fresh_path(spark, "stream_in"), fresh_path(spark, "stream_state")
    for turn, (low, high) in enumerate(((0, 90), (90, 150), (140, 240))):
        spark.createDataFrame([(r, k, float(x[k] + len(r))) for r in ("a", "bb") for k in range(low, high)], "rec string, o long, x double").coalesce(1).write.mode("append").parquet(source)
        made = st.pulse_ticks(st.read_table(spark, source, per_trigger=1), "rec", "o", "x", pulse.Settings(fs=4.0), idle=None)
        got = st.run_to_table(made, "append", base=base)
    for rec in ("a", "bb"):
        want = pulse.replay(x + len(rec), pulse.Settings(fs=4.0))["ticks"]
        own = got.where(F.col("rec") == rec).orderBy("sample").collect()
        assert [(r["sample"], r["n_intervals"]) for r in own] == [(t["sample"], t["n_intervals"]) for t in want] and all(abs(r["sqi"] - t["sqi"]) < 1e-12 for r, t in zip(own, want))


def test_a_repeated_batch_is_in_the_table_once(spark):
    """As after a failure between the sink and the commit: the last batch's commit is gone, so it is made again."""
    source, base = fresh_path(spark, "stream_in"), fresh_path(spark, "stream_state")
    spark.range(10).coalesce(1).write.parquet(source)
    assert st.run_to_table(st.read_table(spark, source), "append", base=base).count() == 10
    delete(spark, f"{base}/checkpoint/commits/0")
    assert st.run_to_table(st.read_table(spark, source), "append", base=base).count() == 10


def test_states_pack_and_unpack():
    kernel = stress.start()
    for k in range(90):
        stress.step(kernel, 60 + k % 7, None if k % 5 == 0 else 40.0, True)
    assert st.StressState.unpack(*st.StressState.pack(kernel)) == kernel
    kernel = pulse.start()
    pulse.advance(kernel, np.random.default_rng(1).random(200) + 100, pulse.Settings(fs=4.0))
    back = st.PulseState.unpack(*st.PulseState.pack(kernel))
    assert all(np.array_equal(back[k], kernel[k]) for k in kernel)
