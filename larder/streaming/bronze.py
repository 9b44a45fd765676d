"""The product dump as a stream: new files are cleaned as they come and merged into a table by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import keyed


def product_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """Rows of tab-separated files that arrive in a folder."""
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("maxFilesPerTrigger", files_at_once).csv(folder)


def upsert_stream(stream: DataFrame, key: str, table: str, checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Each batch's last row of a key, by ``order`` and then by all columns' values as text, replaces the table's (``sources.keyed``): only files that may hold the batch's keys are rewritten. Stops when all files that are there are read."""
    def merge(batch: DataFrame, _: int) -> None:
        keyed.upsert(batch.sparkSession, table, batch, key, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time_col: str, by: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows by time window and kind; rows later than ``late`` are left out once their window is closed."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), by).agg(F.count("*").alias("n")).select("window.start", by, "n")
