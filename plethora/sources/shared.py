"""The folder that driver and executors share, and the tables that an application keeps there while it runs."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders that are deleted when the driver ends: path, and what deletes it.
_ENDING: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary one of our own where that is unset (local tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import shutil
    import tempfile

    own = tempfile.mkdtemp(prefix="plethora-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/plethora/{spark.sparkContext.applicationId}"
    if path not in _ENDING:
        _ENDING[path] = _path(spark, path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder. Frames that read it are void afterwards."""
    p, files = _path(spark, path)
    files.delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete every table that this application keeps in the shared folder, for long sessions."""
    delete(spark, application_folder(spark))


@atexit.register
def _sweep_all() -> None:
    for p, files in _ENDING.values():
        with contextlib.suppress(Py4JError, OSError):  # the engine may have ended before the driver
            files.delete(p, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    This cuts the lineage with a table that survives the loss of any executor; readers see the same rows, row numbers
    included, and count or join them without running df's plan again.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
