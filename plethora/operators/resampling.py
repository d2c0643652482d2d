"""Resampling: draw tables made in the driver by numpy's PCG64, joined to data; weights instead of repeated rows.

A draw table has replicates times subjects rows, whatever the data, and is broadcast while it is small.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plethora.operators.joins import values

SEED = 20260928


def draw_matrix(n: int, reps: int, seed: int = SEED) -> np.ndarray:
    """subjects x replicates: how often each replicate drew each of n subjects, with replacement."""
    random = np.random.default_rng(seed)
    return np.stack([np.bincount(random.choice(n, n), minlength=n) for _ in range(reps)], 1).astype(np.int32)


def half_matrix(n: int, reps: int, seed: int = SEED) -> np.ndarray:
    """subjects x splits: 1 for the random half that calibrates."""
    random = np.random.default_rng(seed)
    return np.stack([(np.argsort(random.permutation(n)) < n // 2) for _ in range(reps)], 1).astype(np.int32)


def bootstrap_draws(spark: SparkSession, subjects: list, reps: int, key: str, kind: str = "long", seed: int = SEED) -> DataFrame:
    """rep, key, mult: how often each replicate drew each subject (or block), with replacement. The order of subjects decides the draws."""
    matrix = draw_matrix(len(subjects), reps, seed)
    rows = [(r, subjects[i], int(matrix[i, r])) for r, i in np.argwhere(matrix.T > 0).tolist()]
    return values(spark, rows, f"rep int, {key} {kind}, mult long")


def interval(df: DataFrame, value: str, *keys: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentiles over replicates; NULLs are left out."""
    return df.groupBy(*keys).agg(F.count(value).alias("reps"), F.percentile(value, low).alias("lo"), F.percentile(value, high).alias("hi"))


def subjects_of(df: DataFrame, key: str, first_seen: str | None = None, most: int = 100_000) -> list:
    """Distinct subjects for a draw table: sorted, or in the order in which they first occur. A draw table is for cohorts, so their number is checked."""
    d = df.groupBy(key).agg(F.min(first_seen or key).alias("_o")).orderBy("_o").limit(most + 1)
    found = [r[0] for r in d.select(key).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} subjects to draw from")
    return found
