"""One long recording over many tasks: slices by row number, with what each needs of its neighbours.

``haloed`` copies the last rows of a slice to the next one (and the first to the one before), so a frame of rows is a window within a
slice. ``filtered`` runs a recursive filter by a scan of its linear recurrence: every slice gives the state that it leaves from rest
and the matrix that carries a state through it; composed in order they tell each slice the state it starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from plethora.functions import dsp
from plethora.operators.order_stats import running
from plethora.sources.shared import stage

#: Rows of a slice.
LENGTH = 1 << 16


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "i", total: str | None = None) -> DataFrame:
    """out: place of the row in its group, from 0, where one group may hold most rows."""
    return running(df, keys, order, out, total=total).withColumn(out, F.col(out) - 1)


def haloed(df: DataFrame, keys: list[str], order: list[Column], before: int, after: int = 0, length: int = LENGTH) -> tuple[DataFrame, WindowSpec]:
    """Rows by slice, with i (place in the group) and _own (false for the copies of neighbours' rows), and the window that orders a slice.

    Expressions over frames that reach at most `before` rows back and `after` rows on are right on own rows; drop the others afterwards
    (``own_rows``).
    """
    length = max(length, before, after, 1)
    d = numbered(df, keys, order)
    s, at = F.floor(F.col("i") / length), F.col("i") % length
    slices = F.array_compact(F.array(s, F.when(at >= length - before, s + 1), F.when((at < after) & (s > 0), s - 1)))
    d = d.withColumn("_slice", F.explode(slices)).withColumn("_own", F.col("_slice") == s)
    return d, Window.partitionBy(*keys, "_slice").orderBy("i")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_slice")


def _through(sections: list, n: int) -> np.ndarray:
    """The matrix that takes the registers of the sections through n samples of silence."""
    size = 2 * len(sections)
    one = np.zeros((size, size))
    for k in range(size):
        registers = [float(j == k) for j in range(size)]
        dsp.cascade(np.zeros(1), sections, registers)
        one[:, k] = registers
    return np.linalg.matrix_power(one, n)


def filtered(df: DataFrame, keys: list[str], order: list[str], value: str, sections: list, length: int = LENGTH) -> DataFrame:
    """keys, i, filtered: the value's samples in their order through second-order sections, from rest."""
    d = numbered(df.select(*keys, *order, F.col(value).cast("double").alias("_x")), keys, [F.asc(c) for c in order], total="_n")
    d = d.select(*keys, "i", "_x", F.floor(F.col("i") / length).alias("_slice"), F.floor((F.col("_n") - 1) / length).alias("_last"))
    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)
    size = 2 * len(sections)

    # A row per slice, so that a task steps through many slices side by side.
    d = d.groupBy(*keys, "_slice", "_last").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "_x"))), lambda r: r["_x"]).alias("_x"))
    d = stage(d, "slices")

    def by_length(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows with slices of one length, and their samples."""
        for at in pdf.groupby(pdf["_x"].map(len), sort=False).indices.values():
            yield at, np.stack([np.asarray(x, float) for x in pdf["_x"].to_numpy()[at]])

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left = np.zeros((len(pdf), size))
            for at, x in by_length(pdf):
                registers = np.zeros((len(at), size))
                dsp.cascades(x, sections, registers)
                left[at] = registers
            yield pdf[[*keys, "_slice", "_last"]].assign(left=list(left))

    carried = _through(sections, length)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """All slices but the last are of full length, so one matrix serves them."""
        pdf, state, starts = pdf.sort_values("_slice"), np.zeros(size), []
        for left in pdf["left"]:
            state = carried @ state + np.asarray(left)
            starts.append(state.tolist())
        return pdf[[*keys]].assign(_slice=pdf["_slice"] + 1, start=starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list = [None] * len(pdf)
            for at, x in by_length(pdf):
                registers = np.stack([np.zeros(size) if s is None else np.asarray(s, float) for s in pdf["start"].to_numpy()[at]])
                for k, y in zip(at, dsp.cascades(x, sections, registers)):
                    found[k] = y
            yield pdf[[*keys, "_slice"]].assign(filtered=found)

    left = stage(d.where(F.col("_slice") < F.col("_last")).select(*keys, "_slice", "_last", "_x").mapInPandas(leave, f"{kinds}, _slice long, _last long, left array<double>"), "left")
    # The second slice starts from what the first leaves; only of longer recordings states are composed.
    second = left.where("_slice = 0").select(*keys, F.lit(1).cast("long").alias("_slice"), F.col("left").alias("start"))
    later = left.where("_last > 1").groupBy(*keys).applyInPandas(compose, f"{kinds}, _slice long, start array<double>").where("_slice > 1")
    starts = second.unionByName(later)
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_of"), "start")
    same = F.col("_slice") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    made = d.join(starts, same, "left").select(*keys, "_slice", "_x", "start").mapInPandas(run, f"{kinds}, _slice long, filtered array<double>")
    made = made.select(*keys, "_slice", F.posexplode("filtered").alias("_at", "filtered"))
    return made.select(*keys, (F.col("_slice") * length + F.col("_at")).alias("i"), "filtered")
