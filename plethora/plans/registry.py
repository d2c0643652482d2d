"""Named queries: each applies operators of the library to the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Registers the function under its name; covers: identifiers of the operator inventory."""

    def add(run):
        QUERIES[run.__name__] = Query(run.__name__, covers, run, sql)
        return run

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of samples or beats: rec, event_id, activity, value, us; ordered within rec by us, event_id."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("rec"), "event_id", F.col("event_type").alias("activity"), "value", micros().alias("us"))


#: The same in SQL, with the packet index i.
EV = """ev AS (SELECT user_id AS rec, event_id, event_type AS activity, value, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""


def r6(c, name: str | None = None):
    """Rounded to six places, as both engines do in comparisons of doubles."""
    c = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return c.alias(name) if name else c
