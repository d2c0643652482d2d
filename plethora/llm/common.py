"""What the operators share: reading, exact key expressions and tables written to the shared folder."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plethora.sources.shared import delete, fresh_path

#: White space of every contract of this subpackage, as a regex class and as plain characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage with a table that survives the loss of any executor; later readers see the same rows,
    monotonically increasing ids included. As a table of its own a join side is also dealt out anew for the join, so that
    adaptive execution can split a hot key's partition (an aggregate by the join's key would keep it whole).
    """
    path = fresh_path(df.sparkSession, name)
    _scopes()[-1].append(path)
    return _written(df, path)


#: Rows of a staged table of two short keys that is broadcast at most (about 15 MB).
FEW = 200_000


def few(table: DataFrame) -> DataFrame:
    """A staged table with a hint to broadcast it while it has at most FEW rows; beyond that both sides of its join are dealt out."""
    return F.broadcast(table) if table.count() <= FEW else table


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that make gives, staged; tables that were staged to make it are deleted."""
    path, scopes = fresh_path(spark, name), _scopes()
    scopes.append([])
    try:
        found = _written(make(), path)
    finally:
        gone = scopes.pop()
    for side in gone:
        delete(spark, side)
    scopes[-1].append(path)
    return found


class rounds_of:
    """A staged table that grows by a part a round; `depth` is the round's number."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, fresh_path(spark, name)
        _scopes()[-1].append(self.path)

    def write(self, depth: int, df: DataFrame) -> DataFrame:
        """The round's rows, written and read back."""
        self.schema = df.schema
        return _written(df, f"{self.path}/depth={depth}")

    def read(self) -> DataFrame:
        """The rows of all rounds, with their depth."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("depth", IntegerType())])).parquet(self.path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OWN = threading.local()


def _scopes() -> list[list[str]]:
    """Paths staged by this thread, for each settled() that it is in; those outside of any go when the application ends."""
    if not hasattr(_OWN, "scopes"):
        _OWN.scopes = [[]]
    return _OWN.scopes


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *without: str) -> Column:
    """All columns as one struct, so that no name of theirs can clash with a name of ours."""
    kept = [column(c) for c in df.columns if c not in without]
    return F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the fast path of lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
