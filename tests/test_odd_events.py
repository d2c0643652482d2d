"""Events that the given tables don't have: values of 0 from the first on, below 0, and beyond 16 bits at the gain written."""

import datetime
import math

import duckdb
import pytest

from plethora.plans import QUERIES
from tests.compare import same


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    start = datetime.datetime(2024, 1, 1)
    values = {1: [0.0] * 12 + [3.0, 9.5], 2: [0.0, 40.0, 40.25, 41.0, 60.0, 0.0], 3: [2.0, -2.0, 2.0, -2.0, 55.0], 4: [1.0, -101.0, 7.0], 5: [650.0, 700.02, 40_000.0, -1e6, 12.5]}
    rows = [(100 * u + k, start + datetime.timedelta(minutes=7 * k), u, "click", v, "{}") for u, own in values.items() for k, v in enumerate(own)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["perfusion_and_saturation", "rolling_sqi_parts", "wfdb_round_trip"])
def test_against_sql(spark, odd, name):
    same(QUERIES[name].run(spark, odd[0]), odd[1], QUERIES[name].sql)


def test_nothing_over_nothing_is_nan(spark, odd):
    """NaN, as in SQL, not NULL."""
    first = QUERIES["perfusion_and_saturation"].run(spark, odd[0]).where("rec = 1 AND i = 0").first()
    assert math.isnan(first.pi) and first["class"] == "good" and first.spo2 is None


def test_many_short_records_are_few_partitions(spark):
    from plethora.sources import recordings
    from plethora.sources.shared import fresh_path

    recordings.register(spark)
    rows = spark.range(2500).selectExpr("string(id % 1250) AS record", "id DIV 1250 AS i", "id * 1.0D AS x").repartition(2, "record").sortWithinPartitions("record", "i")
    path = fresh_path(spark, "wfdb")
    rows.write.format("wfdb").mode("append").options(bits="32").save(path)
    read = spark.read.format("wfdb").option("span", "4").load(path)  # 2500 spans
    assert read.rdd.getNumPartitions() == recordings.TASKS
    assert read.count() == 2500 and read.selectExpr("sum(value)").first()[0] == sum(range(2500))
