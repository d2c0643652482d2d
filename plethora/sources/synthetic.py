"""Seeded synthetic pulse, motion, ECG and stress signals. They are test data, not measurements.

Draws come from numpy's PCG64 in a fixed order, so a seed gives the same signals anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 20260928


def intervals(n: int, mean_ms: float, sd_ms: float, random: np.random.Generator, memory: float = 0.5) -> np.ndarray:
    """First-order autoregressive intervals around a mean."""
    shocks = random.normal(0, sd_ms * np.sqrt(1 - memory**2), n - 1)
    found = [float(mean_ms)]
    for shock in shocks:
        found.append(mean_ms + memory * (found[-1] - mean_ms) + shock)
    return np.array(found)


# Waves after a beat (height, delay s, width s) of the light, and of an ECG.
LIGHT = ((1.0, 0.12, 0.06), (0.35, 0.36, 0.08))
ECG = ((1.0, 0.0, 0.012), (-0.2, 0.03, 0.012), (0.15, 0.25, 0.05))


def waves(since: np.ndarray, shapes: tuple) -> np.ndarray:
    """The sum of bell curves at these times since a beat."""
    total = 0.0
    for height, delay, width in shapes:
        total = total + height * np.exp(-0.5 * ((since - delay) / width) ** 2)
    return total


def pulse(rr_ms: np.ndarray, fs: float, dc: float, modulation: float, noise: float, random: np.random.Generator, seconds: float) -> tuple[np.ndarray, np.ndarray]:
    """Raw light that drops with each pulse (a systolic and a diastolic wave), and the times of the beats in it."""
    beats = np.cumsum(rr_ms) / 1000.0
    t = np.arange(int(seconds * fs)) / fs
    since = t[:, None] - beats[None, :]
    wave = waves(since, LIGHT).sum(1)
    return dc * (1.0 - modulation * wave) + random.normal(0, noise * dc * modulation, t.size), beats[beats < seconds]


# A motion's swing (share, Hz) and drift (share).
SWING, DRIFT = (0.6, 2.1), 0.4


def with_motion(raw: np.ndarray, fs: float, spans: list[tuple[float, float]], size: float, random: np.random.Generator) -> np.ndarray:
    """raw with a swing and a random walk added in each span (s), scaled to a share of the median light."""
    moved = np.zeros(len(raw))
    for first, last in (map(int, np.multiply(span, fs)) for span in spans):
        walk = random.normal(0, 1, last - first).cumsum()
        phase = 2 * np.pi * SWING[1] * np.arange(last - first) / fs
        moved[first:last] = SWING[0] * np.sin(phase) + DRIFT * walk / (np.abs(walk).max() + 1e-12)
    return raw + size * float(np.median(raw)) * moved


# Name, rate, mean and spread of intervals, light level, modulation, seed offset.
CASES = (
    ("clean_nose_100hz", 100.0, 820, 45, 50_000.0, 0.0006, 0),
    ("clean_nose_64hz", 64.0, 760, 35, 30_000.0, 0.0008, 2),
    ("clean_finger_125hz", 125.0, 900, 50, 70_000.0, 0.015, 3),
)


def cases(seed: int = SEED, seconds: int = 120) -> dict[str, tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """name: rate, raw light, beat times, intervals. Beside the clean cases, one with motion and one with a detached sensor."""
    found = {}
    for name, fs, mean, sd, dc, modulation, offset in CASES:
        random = np.random.default_rng(seed + offset)
        rr = intervals(160, mean, sd, random)
        raw, beats = pulse(rr, fs, dc, modulation, 0.05, random, seconds)
        found[name] = (fs, raw, beats, rr[: len(beats)])
    fs, raw, beats, rr = found["clean_nose_100hz"]
    found["motion_nose_100hz"] = (fs, with_motion(raw, fs, [(40, 55), (80, 90)], 0.02, np.random.default_rng(seed + 1)), beats, rr)
    off = raw.copy()
    off[6000:8000] = 5.0 + np.random.default_rng(seed + 4).normal(0, 0.5, 2000)
    found["sensor_off_100hz"] = (fs, off, beats, rr)
    return found


def ecg(rr_s: np.ndarray, fs: float, random: np.random.Generator, noise: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Narrow spikes with a slow wave after each, and their times."""
    beats = np.cumsum(rr_s)
    t = np.arange(int((beats[-1] + 1) * fs)) / fs
    since = t[:, None] - beats[None, :]
    return waves(since, ECG).sum(1) + random.normal(0, noise, t.size), beats


def samples(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """The cases as long rows: record, fs, i, ir."""
    import pandas as pd

    parts = [pd.DataFrame({"record": name, "fs": fs, "i": np.arange(len(raw)), "ir": raw}) for name, (fs, raw, _, _) in cases(seed).items()]
    return spark.createDataFrame(pd.concat(parts), "record string, fs double, i long, ir double")


#: What a recording's intervals are made into.
PARTS = ("i", "ecg", "light", "motion")


def beat_signals(intervals_ms: DataFrame, key: str, order: list[str], value: str, rate: float, light: float = 50_000.0, modulation: float = 0.0006, noise: float = 0.0, shaken: float = 0.0, then: Callable | None = None, fields: str | None = None, parts: tuple[str, ...] = PARTS, together: int = 0) -> DataFrame:
    """key, i, ecg, light, motion: each recording's intervals as the signals of a heart, from its start to a second after its last beat; motion is a slow sway.

    noise: spread of what is added to the light, as a share of a pulse, and to the ECG, as a share of its spike. shaken: size of a motion that
    comes over a hashed part of the recording's spans of ten seconds, in the light as a share of a pulse. Both are seeded by the key.

    then: what to make of a recording in its group, from its signals and the times of its beats (s): columns by name, as in fields; the samples,
    a hundred times the intervals, then go nowhere. parts: those that it takes; ms are the times of the beats as they add up (ms). together: intervals
    that are gathered, at least, before it gets lists of the signals and of the times of their recordings, and makes a list.

    A recording is one group, and a task goes through its recordings one after the other. Only the samples near a beat are touched by its
    waves, so the work grows with the recording's length. What is not a number becomes NULL.
    """
    from plethora.operators.replay import deal, each_group

    def signals_of(group: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        key_, ms = int(group["_key"][0]), np.cumsum(group["_value"].astype(float))
        beats = ms / 1000.0
        n = int((beats[-1] + 1) * rate)
        reach = int(rate)
        at = np.round(beats * rate).astype(int)[:, None] + np.arange(-reach // 4, reach)
        since, inside = at / rate - beats[:, None], (at >= 0) & (at < n)
        summed = {c: np.bincount(at[inside], waves(since, shapes)[inside], n) for c, shapes in (("ecg", ECG), ("light", LIGHT)) if c in parts}
        t = np.arange(n) / rate if "motion" in parts or shaken else None
        sway = np.sin(0.7 * t + key_ % 7) * (1 + key_ % 3) if "motion" in parts else None
        random = np.random.default_rng([SEED, abs(key_)])
        if noise:
            drawn = {c: random.normal(0, noise, n) for c in ("ecg", "light")}
            summed = {c: x + drawn[c] for c, x in summed.items()}
        if shaken:
            rough = np.repeat(random.random(-(-n // int(10 * rate))) < 0.1 + 0.1 * (key_ % 5), int(10 * rate))[:n]
            moved = rough * (SWING[0] * np.sin(2 * np.pi * SWING[1] * t) + random.normal(0, 0.5, n))
            if "light" in parts:
                summed["light"] = summed["light"] + shaken * moved
            sway = sway + 5 * moved if "motion" in parts else None
        ready = {"ms": lambda: ms, "i": lambda: np.arange(n), "ecg": lambda: summed["ecg"], "light": lambda: light * (1 - modulation * summed["light"]), "motion": lambda: sway}
        return {c: ready[c]() for c in parts}, beats

    def plain(made: dict) -> dict[str, list | np.ndarray]:
        return {c: x if isinstance(x, np.ndarray) and x.dtype.kind != "f" else [None if v is None or v != v else v for v in x] for c, x in made.items()}

    def run(group: dict[str, np.ndarray]) -> dict[str, list | np.ndarray]:
        made, beats = signals_of(group)
        return plain(then(made, beats)) if then else made

    def run_many(groups: list[dict[str, np.ndarray]]) -> list[dict[str, list | np.ndarray]]:
        made = [signals_of(g) for g in groups]
        return [plain(x) for x in then([m for m, _ in made], [b for _, b in made])]

    rows = deal(intervals_ms.select(key, *order, value), key)
    rows = rows.select(key, F.col(key).alias("_key"), F.col(value).alias("_value"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_o"))
    return each_group(rows, [key], run_many if together else run, fields or "i long, ecg double, light double, motion double", dealt=True, together=together)
