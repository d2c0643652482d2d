import pytest

from plethora.plans import QUERIES
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_against_sql(spark, duck, name):
    same(QUERIES[name].run(spark, SF), duck, QUERIES[name].sql)


@pytest.mark.parametrize("name", ["session_replay_kernel", "ema_hysteresis_stress", "loso_rankers", "gbm_loso", "conformal_boosted", "cross_site_transfer", "boosted_explanation", "ecg_template"])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from plethora.operators.replay import session_ticks
    from plethora.plans.kernel_queries import _samples

    batch = session_ticks(_samples(spark, SF).select("rec", "i", F.col("value").alias("ir"), F.lit(4.0).alias("fs"), F.lit(0.4).alias("gate")), ["rec"], "i", "ir")
    want = sorted((r.rec, r["sample"], round(r.rmssd, 6), r.n_intervals) for r in batch.collect())
    got = sorted((r.rec, r["sample"], r.rmssd, r.n_intervals) for r in QUERIES["stream_replay"].run(spark, SF).collect())
    assert got == want and got


def test_nearest_match_against_a_loop(spark):
    from plethora.operators.matching import nearest_match

    det = spark.createDataFrame([(1, 10.0), (1, 11.0), (1, 30.0), (2, 5.0)], "k int, t double")
    ref = spark.createDataFrame([(1, 10.6), (1, 10.9), (1, 29.0), (3, 1.0)], "k int, t double")
    got = sorted(map(tuple, nearest_match(det, ref, "k", "t", 1.5).collect()))
    assert got == [(1, 10.6, 11.0), (1, 10.9, 10.0), (1, 29.0, 30.0)]


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
