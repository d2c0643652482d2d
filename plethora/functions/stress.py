"""The 1 Hz stress score: deviation from a personal baseline, smoothed, with levels that hold on.

``step`` takes one tick; the state is a plain dict, so batch and stream share it.
"""

from __future__ import annotations

import math

from plethora.functions.pulse import half_away

# Levels, and the detector's parameters.
UNKNOWN, CALM, AROUSED, STRESSED = range(4)
NAMES = {UNKNOWN: "unknown", CALM: "calm", AROUSED: "aroused", STRESSED: "stressed"}
BASELINE, SLOW, SMOOTHING = 60, 12, 0.35
LEAST_SD = {"hr": 2.0, "hrv": 5.0}
#: Level: (score from which it rises, to), (score below which it falls, to).
RISE = {UNKNOWN: ((65, STRESSED), (35, AROUSED)), CALM: ((65, STRESSED), (35, AROUSED)), AROUSED: ((65, STRESSED),), STRESSED: ()}
FALL = {UNKNOWN: (35, CALM), CALM: (35, CALM), AROUSED: (25, CALM), STRESSED: (55, AROUSED)}


def start() -> dict:
    """A session whose baseline begins now."""
    empty = {"recent": [], "sum": 0.0, "squares": 0.0, "n": 0, "mean": None, "sd": None}
    return {"hr": dict(empty, recent=[]), "hrv": dict(empty, recent=[]), "ticks": 0, "phase": "baseline", "ema": None, "level": UNKNOWN}


def _known(x: float | None) -> bool:
    return x is not None and not math.isnan(x)


def _spread(channel: dict) -> float:
    mean = channel["sum"] / channel["n"]
    return math.sqrt(max(0.0, channel["squares"] / channel["n"] - mean * mean)) if channel["n"] > 1 else 0.0


def _take(state: dict, hr: float | None, hrv: float | None) -> None:
    for name, x in (("hr", hr), ("hrv", hrv)):
        channel = state[name]
        if _known(x):
            channel["recent"] = [*channel["recent"], x][-SLOW:]
            if state["phase"] == "baseline":
                channel["sum"] += x
                channel["squares"] += x * x
                channel["n"] += 1
    if state["phase"] != "baseline":
        return
    state["ticks"] += 1
    if state["ticks"] >= BASELINE:
        # Without any rate there is no baseline, and none is sought again.
        state["phase"] = "scoring" if state["hr"]["n"] else "none"
        if state["phase"] == "scoring":
            for channel in (state["hr"], state["hrv"]):
                if channel["n"]:
                    channel["mean"], channel["sd"] = channel["sum"] / channel["n"], _spread(channel)


def _deviation(channel: dict, name: str, sign: int) -> float | None:
    """0 to 1 over two and a half baseline deviations; None without values or a baseline."""
    if not channel["recent"] or channel["mean"] is None:
        return None
    now = 0.0
    for x in channel["recent"]:
        now += x
    z = sign * (now / len(channel["recent"]) - channel["mean"]) / max(channel["sd"], LEAST_SD[name])
    return min(1.0, max(0.0, z / 2.5))


def step(state: dict, hr: float | None, hrv: float | None, is_open: bool) -> tuple[int, int]:
    """(score, level) after a tick; only open ticks are taken in."""
    if is_open:
        _take(state, hr, hrv)
    if state["phase"] != "scoring":
        return 0, UNKNOWN
    found = [d for d in (_deviation(state["hr"], "hr", 1), _deviation(state["hrv"], "hrv", -1)) if d is not None]
    if not found:
        return 0, UNKNOWN
    raw = sum(0.5 * d for d in found) / (0.5 * len(found)) * 100.0
    state["ema"] = raw if state["ema"] is None else SMOOTHING * raw + (1 - SMOOTHING) * state["ema"]
    score, level = half_away(state["ema"]), state["level"]
    for least, to in RISE[level]:
        if score >= least:
            state["level"] = to
            break
    else:
        if score < FALL[level][0]:
            state["level"] = FALL[level][1]
    return score, state["level"]


def simulate(hr: list, hrv: list, is_open: list) -> list[tuple[int, int]]:
    state = start()
    return [step(state, a, b, bool(c)) for a, b, c in zip(hr, hrv, is_open)]
