"""The causal pulse pipeline: filter, beats, accepted intervals, quality and 1 Hz ticks of a stream of optical samples.

``advance`` takes the next block of samples and a state, so a whole recording is one block and a stream is many; results
don't depend on how samples are cut into blocks. Filtering runs over the block; peaks are picked from the local maxima
alone, and quality is evaluated only where a beat or a tick needs it, from slices of the recent samples. The state is a
plain dict of numbers, lists and arrays: about ten seconds of samples and sixty intervals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import median

import numpy as np

from plethora.functions.dsp import butterworth2, cascade


def in_order(x: np.ndarray) -> float:
    """The sum of the values one after another, without the pairs that numpy's sum makes: gates compare its last bits."""
    return float(np.add.accumulate(x)[-1]) if len(x) else 0.0


def mean_of(x: np.ndarray) -> float:
    return in_order(x) / len(x)


def spread_of(x: np.ndarray, mean: float) -> float:
    """Population spread around the mean."""
    return math.sqrt(in_order((x - mean) ** 2) / len(x))


def half_away(x: float) -> int:
    """Rounded to the nearest integer, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


@dataclass(frozen=True)
class Settings:
    """The pipeline's filter, detector, interval and quality parameters."""

    fs: float = 100.0
    gate: float | None = 0.4  # None: every beat is good enough
    systolic: bool = False  # beats on the negated filtered signal
    low_hz: float = 0.5
    high_hz: float = 3.5
    detector_s: float = 4.0
    refractory_s: float = 0.4
    sigmas: float = 0.8
    quality_s: float = 5.0
    warmup_s: float = 3.0
    shortest_ms: float = 300.0
    longest_ms: float = 1500.0
    plausible: float = 0.30
    kept: int = 60
    recent: int = 8
    rate_from: int = 10
    full_modulation: float = 0.0002
    least_dc: float = 10.0


def start() -> dict:
    return {"n": 0, "registers": [0.0] * 4, "raw": np.zeros(0), "filtered": np.zeros(0), "last_peak": None, "intervals": []}


def mean_square_successive(intervals: list[float]) -> float:
    """RMSSD; 0 with fewer than two intervals. Intervals are few, so plain loops are faster here than arrays; they add up in the same order."""
    total = 0.0
    for a, b in zip(intervals, intervals[1:]):
        total += (b - a) * (b - a)
    return math.sqrt(total / (len(intervals) - 1)) if len(intervals) > 1 else 0.0


def rate(intervals: list[float], last: int) -> float | None:
    return 60000.0 / median(intervals[-last:]) if len(intervals) >= 3 else None


def regularity(intervals: list[float]) -> float:
    """1 - half the coefficient of variation, within 0 and 1; 0 with fewer than three."""
    if len(intervals) < 3:
        return 0.0
    mean = total = 0.0
    for x in intervals:
        mean += x
    mean /= len(intervals)
    for x in intervals:
        total += (x - mean) * (x - mean)
    return min(1.0, max(0.0, 1.0 - 0.5 * math.sqrt(total / len(intervals)) / mean)) if mean > 0 else 0.0


def quality(raw: np.ndarray, filtered: np.ndarray, intervals: list[float], least: int, s: Settings) -> dict:
    """The quality index and its parts from the samples in its window."""
    none = {"sqi": 0.0, "mod": None, "mod_score": 0.0, "per": 0.0, "penalty": 1.0}
    if len(raw) < least:
        return none | {"reject": "warmup"}
    dc = mean_of(raw)
    if dc < s.least_dc:
        return none | {"reject": "presence"}
    if float(raw.max() - raw.min()) < 1e-3:
        return none | {"reject": "flat"}
    mod = float(filtered.max() - filtered.min()) / dc
    score, per = min(1.0, max(0.0, mod / s.full_modulation)), regularity(intervals)
    penalty = 0.0 if mod > 0.03 else 0.5 if mod > 0.02 else 1.0
    weak = score < 0.1
    return {"sqi": 0.0 if weak else min(1.0, max(0.0, (0.40 * score + 0.60 * per) * penalty)), "mod": mod, "mod_score": score, "per": per, "penalty": penalty, "reject": "zombie" if weak else ""}


def acceptable(dt: float, intervals: list[float], s: Settings) -> bool:
    if not s.shortest_ms < dt < s.longest_ms:
        return False
    if len(intervals) < 3:
        return True
    recent = sorted(intervals[-s.recent :])
    middle = recent[len(recent) // 2]  # the upper one of two
    return abs(dt - middle) <= s.plausible * middle


def band_passed(samples: np.ndarray, s: Settings, registers: list[float]) -> np.ndarray:
    """Means of neighbours through the high pass, then the low pass: one value less than samples."""
    return cascade((samples[:-1] + samples[1:]) / 2, [butterworth2(s.fs, s.low_hz, "high"), butterworth2(s.fs, s.high_hz, "low")], registers)


def advance(state: dict, block: np.ndarray, s: Settings, keep_samples: bool = False, passed: np.ndarray | None = None, ticking: bool = True) -> dict:
    """Updates the state; returns beats, peaks, ticks (lists) and, if asked for, the block's filtered samples. passed: band_passed() of a whole recording, for settings that share it. ticking: whether ticks are asked for; beats don't depend on them."""
    block = np.asarray(block, float)
    n0, n = state["n"], state["n"] + len(block)
    if not len(block):
        return {"beats": [], "peaks": [], "ticks": [], "filtered": np.zeros(0)}
    raw = np.concatenate([state["raw"], block])
    offset = n0 - len(state["raw"])  # packet number of raw[0]
    if passed is None:
        passed = band_passed(raw[max(n0 - offset - 1, 0) :], s, state["registers"])
    filtered = np.concatenate([state["filtered"], passed if n0 else np.append(0.0, passed)])  # packet 0 passes nothing on

    detect = -filtered if s.systolic else filtered
    width, rest = half_away(s.fs * s.detector_s), half_away(s.fs * s.refractory_s)
    span, warm, every = half_away(s.fs * s.quality_s), half_away(3.0 * s.fs if s.warmup_s == 3.0 else s.warmup_s * s.fs), half_away(s.fs)
    at = np.arange(max(n0, 1), n) - offset  # packets that reach the detector
    value = lambda k: np.where(k + offset >= 1, detect[np.maximum(k, 0)], 0.0)
    tops = at[(value(at - 1) > value(at - 2)) & (value(at - 1) > detect[at]) & (at + offset >= width // 2)]

    def known(packet: int) -> dict:
        """Quality once this packet has been pushed."""
        first = max(warm, packet - span + 1) - offset
        last = packet - offset + 1
        return quality(raw[first:last] if last > first else raw[:0], filtered[first:last] if last > first else filtered[:0], state["intervals"], span // 2, s)

    beats, peaks, ticks = [], [], []

    def tick(packet: int) -> None:
        iv = state["intervals"]
        ticks.append({"sample": packet, **known(packet), "rmssd": mean_square_successive(iv), "hr": rate(iv, s.rate_from), "n_intervals": len(iv)})

    due = n0 + (every - 1 - n0 % every) if ticking else n  # the next packet that ends a second
    for k in tops.tolist():
        packet = k + offset
        while due < packet:
            tick(due)
            due += every
        if state["last_peak"] is not None and packet - state["last_peak"] < rest:
            continue
        window = detect[max(k - width + 1, 1 - offset, 0) : k + 1]
        level = mean_of(window)
        if detect[k - 1] < level or not detect[k - 1] > level + s.sigmas * spread_of(window, level):  # the spread is no less than 0
            continue
        peaks.append(packet)
        if state["last_peak"] is not None:
            dt = (packet - state["last_peak"]) / s.fs * 1000.0
            seen = None if s.gate is None else known(packet - 1)["sqi"]
            good = (seen is None or seen >= s.gate) and acceptable(dt, state["intervals"], s)
            if good:
                state["intervals"] = [*state["intervals"], dt][-s.kept :]
            beats.append({"packet": packet, "dt_ms": dt, "accepted": good, "sqi": seen})
        state["last_peak"] = packet
    while due < n:
        tick(due)
        due += every
    tail = max(width, span) + 2
    state |= {"n": n, "raw": raw[-tail:].copy(), "filtered": filtered[-tail:].copy()}
    return {"beats": beats, "peaks": peaks, "ticks": ticks, "filtered": filtered[n0 - offset :] if keep_samples else np.zeros(0)}


def replay(samples: np.ndarray, s: Settings, keep_samples: bool = False, passed: np.ndarray | None = None, ticking: bool = True) -> dict:
    return advance(start(), samples, s, keep_samples, passed, ticking)
