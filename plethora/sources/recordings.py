"""A data source for recordings in WFDB formats 16 and 32: `spark.read.format("wfdb")` and `df.write.format("wfdb")`.

A record is a header and a data file of frames, a 16- or 32-bit number per signal each. Reading lists the folder in the driver, cuts each data
file into spans and deals these to TASKS partitions at most, so one long record is read by many tasks and many short ones by few; a task
reads the headers of its spans and, by ranged reads, their own bytes, and decodes the channels that are asked for and no others. Writing
takes rows (record, i, signals as columns) that are dealt by record; each task writes whole records under names of its own attempt, and the
commit gives them their names, so a task that is made again leaves nothing behind.

Paths are those of any store that pyarrow knows (file, HDFS, S3); options: `signals` (comma-separated, default all), `span` (bytes of a
span), `fs` (rate to write), `gain` (steps per unit to write), `bits` (16 or 32, to write). A missing value is the lowest number. Values
beyond the bits fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from plethora.sources.files import WFDB_NUMBERS, wfdb_header

SPAN, TASKS, BATCH = 32 << 20, 1000, 1 << 16
SCHEMA = "record string, fs double, signal string, i long, value double"


@dataclass
class Spans(InputPartition):
    parts: list  # (path of a header, number of the span, spans of its record)


class WfdbReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.span = options["path"], int(options.get("span", SPAN))
        self.wanted = [x.strip() for x in options["signals"].split(",")] if options.get("signals") else None

    def partitions(self) -> list[Spans]:
        files, folder = pafs.FileSystem.from_uri(self.path)
        sizes = {info.path: info.size for info in files.get_file_info(pafs.FileSelector(folder, recursive=True)) if info.path.endswith((".hea", ".dat"))}
        spans = []
        for path in sorted(p for p in sizes if p.endswith(".hea")):
            n = max(1, -(-sizes.get(path.removesuffix(".hea") + ".dat", 0) // self.span))
            spans += [(path, k, n) for k in range(n)]
        tasks = min(len(spans), TASKS)
        return [Spans(spans[len(spans) * k // tasks : len(spans) * (k + 1) // tasks]) for k in range(tasks)] or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        """Short spans go on together, in batches of about BATCH rows."""
        held, rows = [], 0
        for batch in self._decoded(partition):
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _decoded(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        for path, k, n in partition.parts:
            with files.open_input_file(path) as file:
                head = wfdb_header(file.read().decode())
            signals, (folder, _, record) = head["signals"], path.removesuffix(".hea").rpartition("/")
            channels = [(j, s["name"], s["gain"], s["baseline"]) for j, s in enumerate(signals) if self.wanted is None or s["name"] in self.wanted]
            if not channels:
                continue
            kind = np.dtype(WFDB_NUMBERS[signals[0]["format"]])
            missing, width = np.iinfo(kind).min, kind.itemsize * len(signals)
            with files.open_input_file(f"{folder}/{signals[0]['file']}") as file:
                total = file.size() // width
                first, end = total * k // n, total * (k + 1) // n
                for low in range(first, end, BATCH):
                    frames = min(BATCH, end - low)
                    raw = np.frombuffer(file.read_at(width * frames, width * low), kind).reshape(frames, len(signals))
                    at = pa.array(np.arange(low, low + frames))
                    for j, name, gain, zero in channels:
                        value = pa.array((raw[:, j] - zero) / gain, mask=raw[:, j] == missing)
                        yield pa.RecordBatch.from_arrays([pa.array([record] * frames), pa.array(np.full(frames, head["fs"])), pa.array([name] * frames), at, value], names=["record", "fs", "signal", "i", "value"])


@dataclass
class Written(WriterCommitMessage):
    names: list  # (written as, to be)


class WfdbWriter(DataSourceWriter):
    def __init__(self, options: dict, signals: list[str]):
        self.path, self.fs, self.gain, self.signals = options["path"], float(options.get("fs", 1)), float(options.get("gain", 200)), signals
        self.format = str(options.get("bits", "16"))
        if self.format not in WFDB_NUMBERS:
            raise ValueError(f"bits: one of {', '.join(WFDB_NUMBERS)}")

    def write(self, rows: Iterator) -> Written:
        """Rows of a record follow each other, in their order."""
        files, folder = pafs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)
        kind = np.dtype(WFDB_NUMBERS[self.format])
        missing, top = int(np.iinfo(kind).min), int(np.iinfo(kind).max)
        names, attempt, record, stream, n = [], uuid.uuid4().hex, None, None, 0

        def close() -> None:
            stream.close()
            lines = [f"{record} {len(self.signals)} {self.fs:g} {n}", *[f"{record}.dat {self.format} {self.gain:g} {self.format} 0 0 0 0 {s}" for s in self.signals]]
            with files.open_output_stream(f"{folder}/_{attempt}-{record}.hea") as file:
                file.write(("\n".join(lines) + "\n").encode())
            names.extend((f"_{attempt}-{record}.{kind}", f"{record}.{kind}") for kind in ("dat", "hea"))

        for row in rows:
            if row["record"] != record:
                if stream:
                    close()
                if f"{row['record']}.dat" in {to for _, to in names}:
                    raise ValueError(f"rows of record {row['record']} do not follow each other")
                record, n = row["record"], 0
                stream = files.open_output_stream(f"{folder}/_{attempt}-{record}.dat", buffer_size=1 << 20)
            if row["i"] != n:
                raise ValueError(f"record {record} has no sample {n}")
            frame = [missing if row[s] is None else round(row[s] * self.gain) for s in self.signals]
            if any(row[s] is not None and not missing < x <= top for s, x in zip(self.signals, frame)):
                raise ValueError(f"record {record}: a value is beyond {self.format} bits at this gain")
            stream.write(np.array(frame, kind).tobytes())
            n += 1
        if stream:
            close()
        return Written(names)

    def commit(self, messages: list) -> None:
        files, folder = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for made, name in message.names if message else []:
                files.move(f"{folder}/{made}", f"{folder}/{name}")

    def abort(self, messages: list) -> None:
        files, folder = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for made, _ in message.names if message else []:
                files.delete_file(f"{folder}/{made}")


class WfdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WfdbReader:
        return WfdbReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WfdbWriter:
        return WfdbWriter(dict(self.options), [f.name for f in schema.fields if f.name not in ("record", "i")])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WfdbSource)
