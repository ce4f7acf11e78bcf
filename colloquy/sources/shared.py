"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset on a local master, as in tests, a temporary
    folder takes its place; on a cluster a machine's own folder would lose files, so that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and context._jsc.sc().getCheckpointDir().isEmpty() and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        base = base or tempfile.mkdtemp(prefix="colloquy-shared-")
        context.setCheckpointDir(base)
    base = base or context._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, without lineage."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; removed when the driver ends."""
    folder = f"{shared_base(spark)}/colloquy-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended first; the folder is then the cluster's to clean
            pass


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors; smaller than a checkpoint, and its columns can be left out."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """`df` computed once into a Parquet table of the shared folder, for as long as the block lasts. What is cached
    instead is computed again once a table that it was read from is refreshed or added to."""
    spark, folder = df.sparkSession, f"{shared_base(df.sparkSession)}/colloquy-{uuid.uuid4().hex}"
    try:
        df.write.parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        _remove(spark, folder)
