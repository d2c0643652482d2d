"""Windows: packets, rolling frames, tumbling windows, fixed sessions, samples at a window's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

ORIGIN_S, WINDOW_S, SESSION_S = 10, 60, 1800


def ordered(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def packet_index(df: DataFrame, key: str, *order: str) -> DataFrame:
    """i: position of the row in its recording, from 0."""
    return df.withColumn("i", F.row_number().over(ordered(key, *order)) - 1)


def last_n(key: str, n: int, *order: str) -> WindowSpec:
    return ordered(key, *order).rowsBetween(-(n - 1), 0)


def tumbling(t: Column, origin: float = ORIGIN_S, size: float = WINDOW_S) -> Column:
    """Number of the window [start, end) that holds t; NULL before the origin."""
    return F.when(t >= origin, F.floor((t - origin) / size))


def tumbling_right(t: Column, origin: float = ORIGIN_S, size: float = WINDOW_S) -> Column:
    """Number of the window (start, end] that holds t; NULL up to the origin."""
    return F.when(t > origin, F.ceil((t - origin) / size) - 1)


def complete(window: Column, duration: Column, origin: float = ORIGIN_S, size: float = WINDOW_S) -> Column:
    return origin + (window + 1) * size <= duration + 1e-9


def session_number(t: Column, origin: float = ORIGIN_S, size: float = SESSION_S) -> Column:
    return F.floor((t - origin) / size)


def shifted_gate(quality: Column, threshold: float, over: WindowSpec) -> Column:
    """A tick is open if the tick before it was good enough; the first is shut."""
    return F.coalesce(F.lag(quality >= threshold).over(over), F.lit(False))


def at_window_end(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """The values of the last row in each group."""
    return df.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def spread_row_number(df: DataFrame, keys: list[str], order: list[Column], out: str = "rn", total: str | None = None) -> DataFrame:
    """Row numbers in each group of keys where one group may hold most rows; total: also the rows of the group."""
    from plethora.operators.order_stats import running

    return running(df, keys, order, out, total=total)
