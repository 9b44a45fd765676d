"""Intermediate tables in the cluster's shared checkpoint folder.

Iterative operators cut their lineage by writing a Parquet table there and reading it again.
A lost executor then costs a re-read, never a re-run of the whole history.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that were staged within each open ``scope``, the innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a temporary one on a local master (it goes with the process), and an error on any other: executors don't share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
            made = tempfile.mkdtemp(prefix="larder-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            context.setCheckpointDir(made)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _SCOPES:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of the tables that are staged inside, for ``remove`` once what reads them has been written."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES[:] = [held for held in _SCOPES if held is not paths]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables. No DataFrame that reads them may be used afterwards."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts go to Python in batches of a few megabytes: what a worker and the JVM's Arrow buffers hold follows the batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
