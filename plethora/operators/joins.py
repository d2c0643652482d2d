"""Joins with small sides: parameter tables, validated and self-derived dimensions, splits by subject, replicates.

Sides that are broadcast are checked by ``small``. As-of joins are in ``asof``, matches within a tolerance in ``matching``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plethora.operators.cleaning import assert_unique
from plethora.sources.shared import stage

#: Rows of a parameter table (folds, grids, draws) that is broadcast at most; larger ones are joined by key.
SMALL = 200_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A hint to broadcast df while it has at most SMALL rows. rows: the count, where it is known; otherwise df is written as a table of its own and that is counted, so that its plan runs once."""
    if rows is None:
        df = stage(df, "small")
        rows = df.count()
    return F.broadcast(df) if rows <= SMALL else df


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter table of the driver."""
    return small(spark.createDataFrame(list(rows), schema), len(rows))


def left_validated(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails when it runs if the right side has two rows of a key."""
    return left.join(assert_unique(right, *on), on, "left")


def attach_first(df: DataFrame, keys: list[str], is_first: Column, value: str, out: str) -> DataFrame:
    """The value of a group's marked row (its baseline minute) on all rows of the group."""
    return df.withColumn(out, F.first(F.when(is_first, F.col(value)), True).over(Window.partitionBy(*keys)))


def subject_split(df: DataFrame, key: str, subjects: DataFrame, inside: bool = True) -> DataFrame:
    return df.join(small(subjects.select(key).distinct()), key, "left_semi" if inside else "left_anti")


def replicate(df: DataFrame, draws: DataFrame, key: str) -> DataFrame:
    """Rows with the replicates that drew their key: rep, mult. Weight by mult instead of repeating rows."""
    return df.join(draws, key)


def grid(df: DataFrame, params: DataFrame) -> DataFrame:
    """Every row under every setting; params is a broadcast table of the driver."""
    return df.crossJoin(params)
