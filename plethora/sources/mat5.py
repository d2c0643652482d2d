"""MAT-files of version 5: numbers, text, cells and nested structs, compressed or not.

``read`` gives plain Python: structs as dicts (arrays of them as lists of dicts), cells as lists, numbers as arrays. Files
are decoded in Arrow batches, one per row, so they spread over tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plethora.operators.cleaning import nan_to_null

# Element types of the format, and array classes.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_TEXT = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
_MATRIX, _COMPRESSED = 14, 15
_CELL, _STRUCT, _CHAR = 1, 2, 4


class _Elements:
    """The elements of a buffer, one after another."""

    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def __bool__(self) -> bool:
        return self.at + 8 <= len(self.data)

    def next(self) -> tuple[int, bytes]:
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if kind >> 16:  # a small element: size and type share four bytes, the data are in the other four
            body = self.data[self.at + 4 : self.at + 4 + (kind >> 16)]
            self.at += 8
            return kind & 0xFFFF, body
        body = self.data[self.at + 8 : self.at + 8 + size]
        self.at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)
        return kind, body

    def numbers(self) -> np.ndarray:
        kind, body = self.next()
        return np.frombuffer(body, self.order + _NUMBERS[kind])


def _matrix(body: bytes, order: str):
    """(name, value) of a matrix element."""
    parts = _Elements(body, order)
    kind = int(parts.numbers()[0]) & 0xFF
    shape = tuple(int(n) for n in parts.numbers())
    name = bytes(parts.numbers().astype(np.uint8)).decode("ascii")
    count = int(np.prod(shape))
    inner = lambda: _matrix(parts.next()[1], order)[1]
    if kind == _CELL:
        return name, [inner() for _ in range(count)]
    if kind == _STRUCT:
        width = int(parts.numbers()[0])
        raw = bytes(parts.numbers().astype(np.uint8))
        fields = [raw[k : k + width].split(b"\0")[0].decode("ascii") for k in range(0, len(raw), width)]
        found = [{f: inner() for f in fields} for _ in range(count)]
        return name, found[0] if count == 1 else found
    if kind == _CHAR:
        what, text = parts.next()
        return name, text.decode(_TEXT[what]) if what in _TEXT else "".join(map(chr, np.frombuffer(text, order + _NUMBERS[what])))
    return name, parts.numbers().astype(float).reshape(shape, order="F")


def read(content: bytes) -> dict:
    """The variables of a file."""
    order = "<" if content[126:128] == b"IM" else ">"
    found, parts = {}, _Elements(content[128:], order)
    while parts:
        kind, body = parts.next()
        if kind == _COMPRESSED:
            kind, body = _Elements(zlib.decompress(body), order).next()
        if kind == _MATRIX:
            name, value = _matrix(body, order)
            found[name] = value
    return found


def channels(spark: SparkSession, path: str, fields: dict[str, list[str]], rate: list[str]) -> DataFrame:
    """record, fs, channel, i, value. fields: where each channel is, as names from the outermost struct in; rate: where the sampling rate is, below a channel's parent.

    Fails on a file whose channels have different rates.
    """

    def at(found, names):
        for name in names:
            found = found[name]
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                data = read(content)
                rates = {float(np.ravel(at(data, [*where[:-1], *rate]))[0]) for where in fields.values()}
                if len(rates) != 1:
                    raise ValueError(f"{name}: channels have different rates")
                for channel, where in fields.items():
                    x = np.ravel(at(data, where))
                    yield pd.DataFrame({"record": name.rsplit("/", 1)[-1].removesuffix(".mat"), "fs": rates.copy().pop(), "channel": channel, "i": np.arange(len(x)), "value": x})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").option("recursiveFileLookup", True).load(path)
    return nan_to_null(files.select("path", "content").mapInPandas(run, "record string, fs double, channel string, i long, value double"))


def extract(spark: SparkSession, path: str, out: str, fields: dict[str, list[str]], rate: list[str]) -> None:
    """The channels as Parquet by record, to be scanned by column from then on."""
    channels(spark, path, fields, rate).repartition("record", "channel").sortWithinPartitions("record", "channel", "i").write.mode("overwrite").option("compression", "zstd").partitionBy("record").parquet(out)
    counts = spark.read.parquet(out).groupBy("record", "channel").agg(F.count(F.lit(1)).alias("n"))
    if counts.where("n = 0").count():
        raise ValueError("a channel is empty")
