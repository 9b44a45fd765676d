"""Cutting the lineage of rounds in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Where none is set, a local master gets a temporary one; any other needs ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="larder-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as written to the checkpoint folder: a lost executor costs a re-read, and plans of rounds don't grow."""
    folder(df.sparkSession)
    return df.checkpoint()


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of (id, parent) rows without cycles, where ids without a row are roots: chains halve in each round."""
    found = settled(parents.select("id", "parent"))
    while True:
        up = found.select(F.col("id").alias("parent"), F.col("parent").alias("_above"))
        found = settled(found.join(up, "parent", "left").select("id", F.coalesce("_above", "parent").alias("parent"), F.col("_above").isNotNull().alias("_moved")))
        if not found.where("_moved").limit(1).count():
            return found.select("id", F.col("parent").alias("root"))
        found = found.select("id", "parent")
