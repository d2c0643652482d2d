"""Sequential kernels over recordings as grouped maps: sessions, stress scores, filters, per-window features, ECG beats.

A recording is one group: its samples depend on each other in order. Recordings are dealt to an explicit number of tasks by
key, as kernels cost far more than their bytes and adaptive execution would merge a small shuffle into one task; ``dealt``
says that a frame is dealt by its keys already, so that windows before the kernel share its one shuffle. All variants of a
replay (gates, polarity) run in the group of their recording, which is filtered once per polarity. For recordings too long
for one task's memory the streaming twins carry the same state from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plethora.functions import dsp, pulse, stress
from plethora.operators.cleaning import rejection_proxy  # noqa: F401  (the same proxy, as a column)
from plethora.operators.joins import values

TICKS = "sample long, sqi double, rmssd double, hr double, n_intervals int, mod double, mod_score double, per double, penalty double, reject string"
BEATS = "packet long, dt_ms double, accepted boolean, sqi double"
#: name: (gate, systolic, inverted).
VARIANTS = {"off": (None, False, False), "gate_0.2": (0.2, False, False), "gate_0.3": (0.3, False, False), "gate_0.4": (0.4, False, False), "inverted": (None, False, True), "v2": (None, True, False), "v2_gate_0.4": (0.4, True, False)}


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def with_variants(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Each recording once per variant: variant, gate (NULL: none), systolic, inverted."""
    rows = [(n, *VARIANTS[n]) for n in names or VARIANTS]
    return samples.crossJoin(values(samples.sparkSession, rows, "variant string, gate double, systolic boolean, inverted boolean"))


def _settings(pdf: pd.DataFrame, fs: float | None) -> tuple[np.ndarray, pulse.Settings]:
    first = pdf.iloc[0]
    x = pdf["x"].to_numpy(float)
    gate = first["gate"] if "gate" in pdf else None
    if bool(first.get("inverted", False)):
        x = 2 * np.median(x) - x
    return x, pulse.Settings(fs=float(first["fs"]) if fs is None else fs, gate=None if gate is None or pd.isna(gate) else float(gate), systolic=bool(first.get("systolic", False)))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys to as many tasks as shuffles have, or the cluster has cores."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _groups(rows: DataFrame, keys: list[str], dealt: bool):
    return (rows if dealt else deal(rows, *keys)).groupBy(*keys)


def each_group(rows: DataFrame, keys: list[str], run: Callable, fields: str, dealt: bool = False, together: int = 0) -> DataFrame:
    """keys and what run makes of the columns of each group (by name, as arrays or lists), whose rows come in the order of _o. A task goes through its groups one after the other, so that a short recording costs no call of its own; it holds a batch and the longest group.

    together: rows that are gathered, at least, before run gets their groups as a list, of which it makes a list; 0: run gets each group.
    """
    w = Window.partitionBy(*keys).orderBy("_o")
    d = (rows if dealt else deal(rows, *keys)).withColumn("_first", F.row_number().over(w) == 1)  # the window leaves each task's rows by key and order
    schema = ", ".join(f"{k} {_kind(rows, k)}" for k in keys) + ", " + fields
    kinds = {c.split()[0]: c.split()[1] for c in fields.split(", ")}
    types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def made(table: pa.Table) -> pa.RecordBatch:
        starts = np.flatnonzero(table.column("_first").to_numpy())
        columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in keys}
        out: dict = {c: [] for c in kinds}
        sizes = []
        groups = ({c: v[a:b] for c, v in columns.items()} for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]))
        for found in run(list(groups)) if together else map(run, groups):
            for c in kinds:
                out[c].append(found[c])
            sizes.append(len(found[next(iter(kinds))]))
        own = table.select(keys).take(pa.array(np.repeat(starts, sizes)))
        return pa.table({**{k: own.column(k) for k in keys}, **{c: pa.array(joined(out[c]), types[k]) for c, k in kinds.items()}}).combine_chunks()

    def joined(parts: list):
        return np.concatenate(parts) if all(isinstance(x, np.ndarray) for x in parts) else list(chain.from_iterable(parts))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(starts) and sum(map(len, held)) + len(batch) >= together:
                held.append(batch.slice(0, starts[-1]))
                whole, held = pa.Table.from_batches(held), [batch.slice(starts[-1])]
                if len(whole):
                    yield from made(whole).to_batches()
            else:
                held.append(batch)
        if held:
            yield from made(pa.Table.from_batches(held)).to_batches()

    return d.mapInArrow(go, schema)


def _grouped(samples: DataFrame, keys: list[str], order: str, value: str, extra: list[str]) -> DataFrame:
    return samples.select(*keys, F.col(order).alias("_o"), F.col(value).alias("x"), *[c for c in extra if c in samples.columns and c not in keys])


def variant_ticks(samples: DataFrame, keys: list[str], order: list[str], value: str, fs: float, names: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """1 Hz ticks of each recording under each variant: keys, variant, sample, ... One shuffle, and one group per recording."""
    chosen = {n: VARIANTS[n] for n in names or VARIANTS}
    fields = [c.split()[0] for c in TICKS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        x = column("x").astype(float)[np.lexsort([column(f"_o{k}") for k in reversed(range(len(order)))])]
        signals = {flip: 2 * np.median(x) - x if flip else x for flip in {v[2] for v in chosen.values()}}
        passed = {flip: pulse.band_passed(y, pulse.Settings(fs=fs), [0.0] * 4) for flip, y in signals.items()}
        ticks, variant = [], []
        for name, (gate, systolic, flip) in chosen.items():
            found = pulse.replay(signals[flip], pulse.Settings(fs=fs, gate=gate, systolic=systolic), passed=passed[flip])["ticks"]
            ticks += found
            variant += [name] * len(found)
        own = {k: pa.array([v.as_py()] * len(ticks), v.type) for k, v in zip(keys, key)}
        made = {c: pa.array([t[c] for t in ticks], kinds[k]) for c, k in (c.split() for c in TICKS.split(", "))}
        return pa.table({**own, "variant": pa.array(variant, pa.string()), **made})

    rows = samples.select(*keys, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(value).cast("double").alias("x"))
    schema = ", ".join(f"{k} {_kind(samples, k)}" for k in keys) + ", variant string, " + TICKS
    return _groups(rows, keys, dealt).applyInArrow(run, schema).select(*keys, "variant", *fields)


_OPTIONS = ["fs", "gate", "systolic", "inverted"]


def session_ticks(samples: DataFrame, keys: list[str], order: str, value: str, fs: float | None = None, dealt: bool = False) -> DataFrame:
    """1 Hz ticks of each session. fs: the rate, or a column of that name. gate, systolic and inverted are read where such columns exist (no gate: 0.4)."""
    has_gate = "gate" in samples.columns

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, s = _settings(pdf.sort_values("_o"), fs)
        s = s if has_gate else pulse.Settings(fs=s.fs, gate=0.4, systolic=s.systolic)
        found = pd.DataFrame(pulse.replay(x, s)["ticks"], columns=[c.split()[0] for c in TICKS.split(", ")])
        return pd.concat([pd.DataFrame([key] * len(found), columns=keys), found], axis=1)

    schema = ", ".join(f"{k} {_kind(samples, k)}" for k in keys) + ", " + TICKS
    return _groups(_grouped(samples, keys, order, value, _OPTIONS), keys, dealt).applyInPandas(run, schema)


def session_beats(samples: DataFrame, keys: list[str], order: str, value: str, fs: float | None = None, dealt: bool = False) -> DataFrame:
    """Every interval that a peak closed: packet, dt_ms, accepted, sqi (what the gate saw)."""
    rows = _grouped(samples, keys, order, value, _OPTIONS)
    has_gate = "gate" in rows.columns

    def run(group: dict[str, np.ndarray]) -> dict[str, list]:
        first = lambda c, other: other if c not in group or pd.isna(group[c][0]) else group[c][0]
        x = group["x"].astype(float)
        x = 2 * np.median(x) - x if first("inverted", False) else x
        gate = first("gate", None) if has_gate else 0.4
        s = pulse.Settings(fs=float(first("fs", np.nan)) if fs is None else fs, gate=None if gate is None else float(gate), systolic=bool(first("systolic", False)))
        found = pulse.replay(x, s, ticking=False)["beats"]
        return {c: [t[c] for t in found] for c in ("packet", "dt_ms", "accepted", "sqi")}

    return each_group(rows, keys, run, BEATS, dealt)


def variant_beats(samples: DataFrame, keys: list[str], order: str, value: str, fs: float, names: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """session_beats() of each recording under each variant: keys, variant, packet, dt_ms, accepted, sqi. A recording is shuffled once, and filtered once per polarity."""
    chosen = {n: pulse.Settings(fs=fs, gate=gate, systolic=systolic) for n, (gate, systolic, _) in VARIANTS.items() if n in (names or VARIANTS)}

    def run(group: dict[str, np.ndarray]) -> dict[str, list]:
        x = group["x"].astype(float)
        signals = {flip: 2 * np.median(x) - x if flip else x for flip in {VARIANTS[n][2] for n in chosen}}
        passed = {flip: pulse.band_passed(y, pulse.Settings(fs=fs), [0.0] * 4) for flip, y in signals.items()}
        found = [(n, b) for n, s in chosen.items() for b in pulse.replay(signals[VARIANTS[n][2]], s, passed=passed[VARIANTS[n][2]], ticking=False)["beats"]]
        return {"variant": [n for n, _ in found], **{c: [b[c] for _, b in found] for c in ("packet", "dt_ms", "accepted", "sqi")}}

    return each_group(_grouped(samples, keys, order, value, []), keys, run, f"variant string, {BEATS}", dealt)


def band_passed(samples: DataFrame, keys: list[str], order: str, value: str, fs: float, low: float = 0.5, high: float = 3.5, dealt: bool = False) -> DataFrame:
    """Causal band pass: high pass, then low pass."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        y = dsp.cascade(pdf["x"].to_numpy(float), [dsp.butterworth2(fs, low, "high"), dsp.butterworth2(fs, high, "low")], [0.0] * 4)
        out = pd.DataFrame([key] * len(pdf), columns=keys)
        return out.assign(**{order: pdf["_o"].to_numpy(), "filtered": y})

    schema = ", ".join(f"{k} {_kind(samples, k)}" for k in keys) + f", {order} {_kind(samples, order)}, filtered double"
    return _groups(_grouped(samples, keys, order, value, []), keys, dealt).applyInPandas(run, schema)


def stress_scores(ticks: DataFrame, keys: list[str], order: str, hr: str, hrv: str, gate: str, dealt: bool = False) -> DataFrame:
    """score and level of each tick; a session starts with its baseline."""

    def run(group: dict[str, np.ndarray]) -> dict[str, list]:
        found = stress.simulate(group["hr"].tolist(), group["hrv"].tolist(), group["gate"].tolist())
        return {order: group["_o"].tolist(), "score": [a for a, _ in found], "level": [b for _, b in found]}

    double = lambda c: F.col(c).cast("double").alias(c)
    rows = ticks.select(*keys, F.col(order).alias("_o"), double(hr).alias("hr"), double(hrv).alias("hrv"), F.coalesce(F.col(gate), F.lit(False)).alias("gate"))
    return each_group(rows, keys, run, f"{order} {_kind(ticks, order)}, score int, level int", dealt)


def ecg_beats(samples: DataFrame, keys: list[str], order: str, value: str, fs: float, dealt: bool = False) -> DataFrame:
    """R-peak times in seconds."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = dsp.r_peaks(pdf.sort_values("_o")["x"].to_numpy(float), fs)
        return pd.DataFrame([key] * len(t), columns=keys).assign(t=t)

    schema = ", ".join(f"{k} {_kind(samples, k)}" for k in keys) + ", t double"
    return _groups(_grouped(samples, keys, order, value, []), keys, dealt).applyInPandas(run, schema)


def resampled(samples: DataFrame, keys: list[str], order: str, value: str, up: int, down: int, dealt: bool = False) -> DataFrame:
    """i, x at up / down times the rate (up 1: decimation)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_o")["x"].to_numpy(float)
        y = dsp.decimate(x, down) if up == 1 else dsp.resample(x, up, down)
        return pd.DataFrame([key] * len(y), columns=keys).assign(i=np.arange(len(y)), x=y)

    schema = ", ".join(f"{k} {_kind(samples, k)}" for k in keys) + ", i long, x double"
    return _groups(_grouped(samples, keys, order, value, []), keys, dealt).applyInPandas(run, schema)


def average_waveform(samples: DataFrame, beats: DataFrame, key: str, fs: float, before_s: float = 0.25, after_s: float = 0.45) -> DataFrame:
    """key, at (samples from the beat), mean: the ensemble average. A sample looks up the beats of its own and the next second, not all of them."""
    b = beats.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("t") - before_s), F.floor(F.col("t") + after_s))))
    s = samples.withColumn("_slot", F.floor(F.col("i") / fs))
    at = F.col("i") - F.round(F.col("t") * fs)
    near = s.join(b, [key, "_slot"]).withColumn("at", at.cast("int")).where(F.col("at").between(-round(before_s * fs), round(after_s * fs) - 1))
    return near.groupBy(key, "at").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def waveform_of(x: np.ndarray, t: np.ndarray, fs: float, before_s: float = 0.25, after_s: float = 0.45) -> dict[str, np.ndarray]:
    """The ensemble average of one recording (at, mean, n) around its beats (s), in its own task."""
    at = np.arange(-round(before_s * fs), round(after_s * fs))
    near = np.floor(np.asarray(t) * fs + 0.5).astype(int)[:, None] + at
    inside = (near >= 0) & (near < len(x))
    n = inside.sum(0)
    total = np.where(inside, x[np.clip(near, 0, max(len(x) - 1, 0))], 0.0).sum(0) if len(x) else np.zeros(len(at))
    return {"at": at[n > 0], "mean": total[n > 0] / n[n > 0], "n": n[n > 0]}


def waveform_shape(average: DataFrame, key: str, fs: float, mean: str = "mean") -> DataFrame:
    """Of an average waveform (key, at, mean): where its largest and smallest value lie after the beat (ms), and its steepest rise over its steepest fall."""
    step = F.col(mean) - F.lag(mean).over(Window.partitionBy(key).orderBy("at"))
    ms = lambda c: c / fs * 1000
    return average.withColumn("_d", step).groupBy(key).agg(
        ms(F.max_by("at", F.struct(mean, -F.col("at")))).alias("max_after_ms"), ms(F.min_by("at", F.struct(mean, "at"))).alias("min_after_ms"),
        F.try_divide(F.max("_d"), F.abs(F.min("_d"))).alias("rise_over_fall"))


def rates_of(x: np.ndarray, acc: np.ndarray, fs: float, origin: float = 10.0, window: float = 60.0) -> dict[str, list]:
    """The same of one recording: win, rate, motion."""
    found: dict = {"win": [], "rate": [], "motion": []}
    for k in range(max(0, int((len(x) / fs + 1e-9 - origin) // window))):
        part = slice(round((origin + k * window) * fs), round((origin + (k + 1) * window) * fs))
        freq, power = dsp.welch(dsp.detrended(x[part]), fs, 16)
        band = (freq > 0.6) & (freq < 3.0)
        for name, v in zip(found, (k, 60 * freq[band][np.argmax(power[band])], acc[part].std())):
            found[name].append(v)
    return found


def spectral_rates(samples: DataFrame, keys: list[str], order: str, value: str, motion: str, fs: float, origin: float = 10.0, window: float = 60.0, dealt: bool = False) -> DataFrame:
    """keys, win, rate (60 times the frequency of the largest power from 0.6 to 3 Hz, of 16 s pieces of the detrended window), motion (spread of the motion in it); complete windows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        found = pd.DataFrame(rates_of(pdf["x"].to_numpy(float), pdf["acc"].to_numpy(float), fs, origin, window))
        return pd.concat([pd.DataFrame([key] * len(found), columns=keys), found], axis=1)

    rows = samples.select(*keys, F.col(order).alias("_o"), F.col(value).alias("x"), F.col(motion).alias("acc"))
    schema = ", ".join(f"{k} {_kind(samples, k)}" for k in keys) + ", win long, rate double, motion double"
    return _groups(rows, keys, dealt).applyInPandas(run, schema)


# Names of the feature catalogue.
FEATURES = (
    "sqi_full", "sqi_amp", "sqi_per", "mod_index", "penalty_frac", "n_peaks", "n_accepted", "reject_frac", "miss_frac_est", "hr_ppg", "rr_cv", "rr_diff_mad_rel",
    "rr_diff_max_rel", "ppg_rmssd", "tmpl_corr_mean", "tmpl_corr_p10", "tmpl_frac_lt08", "skewness", "kurtosis", "spec_purity", "spec_hr_mismatch", "acc_sd", "acc_p2p", "acc_hf_power")


def _template(x: np.ndarray, at: np.ndarray, fs: float) -> dict:
    """Correlation of the beats' segments with their pointwise median."""
    low, high = round(-0.25 * fs), round(0.45 * fs)
    at = at[(at + low >= 0) & (at + high <= len(x))]
    if len(at) < 5:
        return {}
    parts = x[at[:, None] + np.arange(low, high)]
    parts = parts - parts.mean(1, keepdims=True)
    shape = np.median(parts, axis=0)
    c = parts @ shape / (np.sqrt((parts**2).sum(1)) * np.sqrt(shape @ shape) + 1e-12)
    return {"tmpl_corr_mean": c.mean(), "tmpl_corr_p10": np.percentile(c, 10), "tmpl_frac_lt08": (c < 0.8).mean()}


def _shape(x: np.ndarray, fs: float, hr: float | None) -> dict:
    sd = x.std() if len(x) else 0.0
    if len(x) <= 10 * fs or not sd > 0:
        return {}
    z = (x - x.mean()) / sd
    found = {"skewness": (z**3).mean(), "kurtosis": (z**4).mean() - 3}
    peak = dsp.spectral_peak(*dsp.welch(x, fs, 8))
    if peak:
        found["spec_purity"] = peak[1]
        if hr is not None:
            found["spec_hr_mismatch"] = abs(60 * peak[0] - hr)
    return found


def _motion(acc: np.ndarray, fs: float) -> dict:
    if len(acc) <= 10 * fs:
        return {}
    freq, power = dsp.welch(acc - acc.mean(), fs, 4)
    return {"acc_sd": acc.std(), "acc_p2p": np.percentile(acc, 99) - np.percentile(acc, 1), "acc_hf_power": np.log10(power[(freq >= 1) & (freq <= 5)].sum() + 1e-12)}


def recording_features(x: np.ndarray, acc: np.ndarray | None, fs: float, origin: float = 10.0, window: float = 60.0) -> list[dict]:
    """The 24 features of each complete window of a recording (beats on the systolic side, no gate); what has no value is None."""
    run = pulse.replay(x, pulse.Settings(fs=fs, gate=None, systolic=True), keep_samples=True)
    volume, peaks = -run["filtered"], np.array(run["peaks"], int) - 1  # a peak is the sample before its packet
    closed = [(b["packet"] / fs, b["dt_ms"]) for b in run["beats"] if b["accepted"]]
    ticks, rows, t0 = run["ticks"], [], origin
    while t0 + window <= len(x) / fs + 1e-9:
        i0, i1 = round(t0 * fs), round((t0 + window) * fs)
        f: dict = {"t0": t0}
        near = [t for t in ticks if t0 < (t["sample"] + 1) / fs <= t0 + window]
        if near:
            early = [t["reject"] in ("warmup", "presence", "flat") for t in near]
            mods = [t["mod"] for t in near if t["mod"] is not None]
            f |= {"sqi_full": np.median([t["sqi"] for t in near]), "sqi_amp": np.median([0.0 if e or t["reject"] == "zombie" else t["mod_score"] * t["penalty"] for t, e in zip(near, early)])}
            f |= {"sqi_per": np.median([0.0 if e else t["per"] for t, e in zip(near, early)]), "penalty_frac": np.mean([t["penalty"] < 1 for t in near]), "mod_index": np.median(mods) if mods else None}
        own = peaks[(peaks >= i0) & (peaks < i1)]
        rr = np.array([d for t, d in closed if t0 <= t < t0 + window])
        f |= {"n_peaks": float(len(own)), "n_accepted": float(len(rr)), "reject_frac": min(1.0, max(0.0, 1 - len(rr) / len(own))) if len(own) else 1.0}
        if len(rr) >= 3:
            middle, d = np.median(rr), np.abs(np.diff(rr))
            f |= {"hr_ppg": 60000 / middle, "miss_frac_est": min(1.0, max(-1.0, 1 - len(own) / (window * 1000 / middle))), "rr_cv": rr.std() / rr.mean()}
            f |= {"rr_diff_mad_rel": np.median(d) / middle, "rr_diff_max_rel": d.max() / middle, "ppg_rmssd": pulse.mean_square_successive(rr.tolist())}
        part = volume[i0:i1]
        f |= _template(part, own - i0, fs) | _shape(part, fs, f.get("hr_ppg")) | (_motion(acc[i0:i1], fs) if acc is not None else {})
        rows.append({"t0": t0} | {k: None if f.get(k) is None else float(f[k]) for k in FEATURES})
        t0 += window
    return rows


def features_of(x: np.ndarray, acc: np.ndarray | None, fs: float) -> dict[str, list]:
    """Columns of recording_features."""
    rows = recording_features(x, acc, fs)
    return {c: [r[c] for r in rows] for c in ("t0", *FEATURES)}


FEATURE_FIELDS = "t0 double, " + ", ".join(f"{c} double" for c in FEATURES)


def window_features(samples: DataFrame, keys: list[str], order: str, value: str, acc: str | None, fs: float, origin: float = 10.0, window: float = 60.0, dealt: bool = False) -> DataFrame:
    """One row of the 24 features per recording and window."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        found = pd.DataFrame(recording_features(pdf["x"].to_numpy(float), pdf["acc"].to_numpy(float) if acc else None, fs, origin, window), columns=["t0", *FEATURES])
        return pd.concat([pd.DataFrame([key] * len(found), columns=keys), found], axis=1)

    rows = samples.select(*keys, F.col(order).alias("_o"), F.col(value).alias("x"), *([F.col(acc).alias("acc")] if acc else []))
    schema = ", ".join(f"{k} {_kind(samples, k)}" for k in keys) + ", t0 double, " + ", ".join(f"{c} double" for c in FEATURES)
    return _groups(rows, keys, dealt).applyInPandas(run, schema)
