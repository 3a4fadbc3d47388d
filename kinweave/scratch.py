"""Intermediate tables in the folder that all executors share; they go when the run that made them has committed."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_runs: list[list[str]] = []


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; only where none is named and Spark runs in this one process a temporary one takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a table and read it again: its lineage ends here, so a lost executor costs nothing that came before. (``checkpoint()`` would compute it twice.)"""
    spark = df.sparkSession
    at, schema = f"{shared(spark)}/kinweave-run-{uuid.uuid4().hex}", df.schema
    df.write.parquet(at)
    if _runs:
        _runs[-1].append(at)
    return spark.read.schema(schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession) -> str:
    """A new folder for files that are read again; it goes when the driver ends, if Spark still runs then."""

    def clean() -> None:
        if spark._jsc is not None and SparkSession.getActiveSession() is not None:
            _delete(spark, at)

    at = f"{shared(spark)}/kinweave-files-{uuid.uuid4().hex}"
    atexit.register(clean)
    return at


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are settled within, at its end."""
    _runs.append([])
    try:
        yield
    finally:
        for at in _runs.pop():
            _delete(spark, at)
