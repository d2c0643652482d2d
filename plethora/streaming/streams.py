"""Structured Streaming twins: stateful pulse and stress kernels, tumbling and session windows with watermarks.

The stateful operators are processors of transformWithState: one typed value and typed lists per key (``PulseState``, ``StressState``), so a
checkpoint outlives changes of the classes that made it, and a time to live that releases recordings which stay idle. Samples of a
micro-batch are sorted by packet; a packet that comes at or below the last one taken in is late and dropped, and counted in
the state. The sink keeps a folder per batch, so a batch that is repeated after a failure is in the table once.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plethora.functions import pulse, stress
from plethora.sources.shared import fresh_path

#: Typed states need this store of Spark's.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder, as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    is_file = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent())) if is_file else reader.parquet(path)


@contextlib.contextmanager
def _typed_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep typed states; the session's setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(stream: DataFrame, mode: str, last_only: bool = False, base: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into a Parquet table of the shared folder. last_only: complete results, of which the last stays. base: the folder of an earlier run, which goes on from its checkpoint."""
    spark = stream.sparkSession
    base = base or fresh_path(spark, "streams")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/out/none")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/last" if last_only else f"{base}/out/{number:012d}")

    with _typed_store(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def tumbling_counts(stream: DataFrame, ts: str, key: str, value: str, size: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Counts and means per window; ts must be a timestamp with time zone for the watermark."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), key, "n", "mean")


def gap_sessions(stream: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


#: Idle time (processing time) after which a recording's state is released. None: never, for runs over what is there, as a stream that watches the clock doesn't end.
IDLE = "24 hours"


class PulseState:
    """The pulse kernel's state in typed columns."""

    values = "last long, late long, n long, last_peak long, r0 double, r1 double, r2 double, r3 double"
    lists = {"samples": "raw double, filtered double", "intervals": "ms double"}
    start = staticmethod(pulse.start)

    @staticmethod
    def pack(kernel: dict) -> tuple[tuple, dict[str, list[tuple]]]:
        samples = list(zip(kernel["raw"].tolist(), kernel["filtered"].tolist()))
        peak = None if kernel["last_peak"] is None else int(kernel["last_peak"])
        return (int(kernel["n"]), peak, *map(float, kernel["registers"])), {"samples": samples, "intervals": [(float(x),) for x in kernel["intervals"]]}

    @staticmethod
    def unpack(value: tuple, lists: dict[str, list[tuple]]) -> dict:
        raw, filtered = (np.array([x[k] for x in lists["samples"]], float) for k in (0, 1))
        return {"n": value[0], "last_peak": value[1], "registers": list(value[2:6]), "raw": raw, "filtered": filtered, "intervals": [x[0] for x in lists["intervals"]]}


class StressState:
    """The stress kernel's state in typed columns."""

    values = "last long, late long, ticks int, phase string, ema double, level int, " + ", ".join(f"{c}_{f} {kind}" for c in ("hr", "hrv") for f, kind in (("sum", "double"), ("squares", "double"), ("n", "int"), ("mean", "double"), ("sd", "double")))
    lists = {"hr_recent": "x double", "hrv_recent": "x double"}
    start = staticmethod(stress.start)
    FIELDS = ("sum", "squares", "n", "mean", "sd")

    @classmethod
    def pack(cls, kernel: dict) -> tuple[tuple, dict[str, list[tuple]]]:
        told = [kernel[c][f] for c in ("hr", "hrv") for f in cls.FIELDS]
        return (kernel["ticks"], kernel["phase"], kernel["ema"], kernel["level"], *told), {f"{c}_recent": [(float(x),) for x in kernel[c]["recent"]] for c in ("hr", "hrv")}

    @classmethod
    def unpack(cls, value: tuple, lists: dict[str, list[tuple]]) -> dict:
        channels = {c: dict(zip(cls.FIELDS, value[at : at + 5])) | {"recent": [x[0] for x in lists[f"{c}_recent"]]} for c, at in (("hr", 4), ("hrv", 9))}
        return {"ticks": value[0], "phase": value[1], "ema": value[2], "level": value[3]} | channels


class Recordings(StatefulProcessor):
    """advance(kernel, fresh rows in order) gives the columns of new rows. Rows at or before the last one taken in are late and dropped. A row whose `reset` is true starts the key anew; so does one that comes after the time to live."""

    def __init__(self, key: str, kind: type, advance: Callable[[dict, pd.DataFrame], dict[str, list]], ttl_ms: int | None):
        self.key, self.kind, self.advance, self.ttl_ms = key, kind, advance, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.kind.values, self.ttl_ms)
        self.lists = {name: handle.getListState(name, schema, self.ttl_ms) for name, schema in self.kind.lists.items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.value.get()) if self.value.exists() else None
        last, late = known[:2] if known else (None, 0)
        kernel = self.kind.unpack(known[2:], {n: [tuple(x) for x in s.get()] if s.exists() else [] for n, s in self.lists.items()}) if known else self.kind.start()
        rows = pd.concat(list(rows)).sort_values("o")
        fresh = rows if last is None else rows[rows["o"] > last]
        late += len(rows) - len(fresh)
        if len(fresh):
            last = int(fresh["o"].max())
            turns = fresh["reset"].fillna(False).astype(bool).cumsum()
            for turn, own in fresh.groupby(turns):
                if turn:
                    kernel = self.kind.start()
                found = self.advance(kernel, own)
                if len(next(iter(found.values()))):
                    yield pd.DataFrame({self.key: [key[0]] * len(next(iter(found.values()))), **found})
        value, lists = self.kind.pack(kernel)
        self.value.update((last, late, *value))
        for name, state in self.lists.items():
            state.put(lists[name]) if lists[name] else state.clear()

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, schema: str, kind: type, advance: Callable[[dict, pd.DataFrame], dict[str, list]], idle: str | None) -> DataFrame:
    ttl = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return rows.groupBy(key).transformWithStateInPandas(Recordings(key, kind, advance, ttl), schema, "Append", "ProcessingTime" if idle else "None")


def _reset(reset: str | None):
    return (F.col(reset) if reset else F.lit(False)).alias("reset")


def pulse_ticks(stream: DataFrame, key: str, order: str, value: str, settings: pulse.Settings, reset: str | None = None, idle: str | None = IDLE) -> DataFrame:
    """1 Hz ticks of each recording as its samples arrive. reset: a column that starts a recording anew where it is true."""
    names = ("sample", "sqi", "rmssd", "hr", "n_intervals")

    def advance(kernel: dict, rows: pd.DataFrame) -> dict[str, list]:
        ticks = pulse.advance(kernel, rows["x"].to_numpy(float), settings)["ticks"]
        return {c: [t[c] for t in ticks] for c in names}

    rows = stream.select(key, F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("x"), _reset(reset))
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, sample long, sqi double, rmssd double, hr double, n_intervals int"
    return _stateful(rows, key, schema, PulseState, advance, idle)


def stress_ticks(stream: DataFrame, key: str, order: str, hr: str, hrv: str, gate: str, reset: str | None = None, idle: str | None = IDLE) -> DataFrame:
    """Score and level of each session as its ticks arrive. reset: a column that starts a new baseline where it is true."""

    def advance(kernel: dict, rows: pd.DataFrame) -> dict[str, list]:
        clean = lambda v: None if pd.isna(v) else float(v)
        found = [stress.step(kernel, clean(a), clean(b), bool(c) if not pd.isna(c) else False) for a, b, c in zip(rows["hr"], rows["hrv"], rows["gate"])]
        return {"o": rows["o"].tolist(), "score": [s for s, _ in found], "level": [n for _, n in found]}

    rows = stream.select(key, F.col(order).cast("long").alias("o"), F.col(hr).cast("double").alias("hr"), F.col(hrv).cast("double").alias("hrv"), F.col(gate).alias("gate"), _reset(reset))
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, o long, score int, level int"
    return _stateful(rows, key, schema, StressState, advance, idle)
