"""Sources and sinks: manifests, CSV, JSON reports, NPZ archives, WFDB records, device frames.

Binary formats are read as ``binaryFile`` rows and decoded in Arrow batches, one file per row, so files spread over tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plethora.operators.cleaning import nan_to_null


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name: the words of a text file."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name <> ''")


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Missing and NaN fields as NULL."""
    return nan_to_null(spark.read.schema(schema).csv(path, header=header, nullValue=""))


def json_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """A JSON document over many lines per key, in a folder of its own."""
    text = F.to_json(F.struct(*df.columns), {"pretty": "true"})
    df.select(F.col(key).alias("_key"), text.alias("value")).write.mode("overwrite").partitionBy("_key").text(path)


def document_table(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """line, text: the columns as a table of a document; row numbers the rows from 1."""
    cells = lambda values: F.concat(F.lit("| "), F.array_join(F.array(*values), " | "), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line long, text string")
    return head.union(df.select((F.col(row) + 1).cast("long"), cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))


def metrics_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """A wide report as rows: keys, metric, value."""
    others = [c for c in df.columns if c not in keys]
    return df.unpivot(keys, others, "metric", "value")


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256 of each file's content, to hold against a manifest."""
    return _binary(spark, path, pattern).select("path", F.sha2("content", 256).alias("sha256"))


def npz(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """record, i, value of one channel of each archive; several rows of a channel follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                x = np.load(io.BytesIO(content))[channel].astype(float).ravel()
                yield pd.DataFrame({"record": name.rsplit("/", 1)[-1].removesuffix(".npz"), "i": np.arange(len(x)), "value": np.where(np.isfinite(x), x, np.nan)})

    return nan_to_null(_binary(spark, path, "*.npz").select("path", "content").mapInPandas(run, "record string, i long, value double"))


#: Numbers of a WFDB format; the lowest means missing.
WFDB_NUMBERS = {"16": "<i2", "32": "<i4"}


def wfdb_header(text: str) -> dict:
    """Rate, number of samples and, per signal: file, format, gain, baseline, name."""
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    head, signals = lines[0], []
    for parts in lines[1 : 1 + int(head[1])]:
        gain = parts[2].split("/")[0]
        scale, _, base = gain.partition("(")
        zero = float(base.rstrip(")")) if base else float(parts[4]) if len(parts) > 4 else 0.0
        signals.append({"file": parts[0], "format": parts[1], "gain": float(scale) or 200.0, "baseline": zero, "name": parts[-1]})
    return {"fs": float(head[2].split("/")[0]), "n": int(head[3]) if len(head) > 3 else None, "signals": signals}


def wfdb_signals(header: dict, content: bytes) -> dict[str, np.ndarray]:
    """Physical values of signals of format 16 or 32 that share a file; the lowest number means missing."""
    kind = np.dtype(WFDB_NUMBERS[header["signals"][0]["format"]])
    raw = np.frombuffer(content, kind).reshape(-1, len(header["signals"]))
    return {s["name"]: np.where(raw[:, k] == np.iinfo(kind).min, np.nan, (raw[:, k] - s["baseline"]) / s["gain"]) for k, s in enumerate(header["signals"])}


def wfdb_annotations(content: bytes) -> list[tuple[int, int]]:
    """(sample, code) of an annotation file in MIT format."""
    words, at, found, k = np.frombuffer(content[: len(content) // 2 * 2], "<u2").astype(int), 0, [], 0
    while k < len(words):
        code, step = int(words[k]) >> 10, int(words[k]) & 1023
        k += 1
        if code == 0 and step == 0:
            break
        if code == 59:  # a long step in the next two words
            at += (int(words[k]) << 16 | int(words[k + 1])) if words[k] < 32768 else (int(words[k]) << 16 | int(words[k + 1])) - (1 << 32)
            k += 2
        elif code == 63:  # a note of `step` bytes
            k += (step + 1) // 2
        elif code < 50:
            at += step
            found.append((at, code))
    return found


def wfdb(spark: SparkSession, path: str) -> DataFrame:
    """record, fs, signal, i, value of all records below the path: each header with its data file."""
    head = _binary(spark, path, "*.hea").select(F.regexp_replace("path", r"\.hea$", "").alias("stem"), F.col("content").cast("string").alias("header"))
    data = _binary(spark, path, "*.dat").select(F.regexp_replace("path", r"\.dat$", "").alias("stem"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for stem, header, content in zip(pdf["stem"], pdf["header"], pdf["content"]):
                h = wfdb_header(header)
                for name, x in wfdb_signals(h, content).items():
                    yield pd.DataFrame({"record": stem.rsplit("/", 1)[-1], "fs": h["fs"], "signal": name, "i": np.arange(len(x)), "value": x})

    return nan_to_null(head.join(data, "stem").mapInPandas(run, "record string, fs double, signal string, i long, value double"))


def wfdb_beats(spark: SparkSession, path: str, fs: float, codes: tuple[int, ...] | None = (1,), pattern: str = "*.atr") -> DataFrame:
    """record, t of annotated beats; codes: None takes all, 1 is a normal beat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                t = [sample / fs for sample, code in wfdb_annotations(content) if codes is None or code in codes]
                yield pd.DataFrame({"record": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "t": np.array(t, float)})

    return _binary(spark, path, pattern).select("path", "content").mapInPandas(run, "record string, t double")


def device_frame(frame: Column) -> list[Column]:
    """Fields of a 20-byte frame between braces: four big-endian 24-bit channels in steps of 1/64 nA, and a temperature. NULL for a broken frame."""
    ok = (F.octet_length(frame) == 20) & (F.hex(F.substring(frame, 1, 1)) == "7B") & (F.hex(F.substring(frame, 20, 1)) == "7D")
    number = lambda at, n: F.conv(F.hex(F.substring(frame, at, n)), 16, 10).cast("long")
    channels = [F.when(ok, number(2 + 3 * k, 3) * 0.015625).alias(f"channel_{k}") for k in range(4)]
    t = number(14, 2)
    return [*channels, F.when(ok, F.when(t >= 32768, t - 65536).otherwise(t)).alias("temperature")]
