"""Tables with one row a key, kept as files that a manifest names: a batch rewrites only the files that may hold its keys.

A manifest has a row for each file: its number of rows, the least and the largest key, whether a key is null, and a Bloom filter of the keys. An upsert looks the batch's keys up in the
manifest, reads the files that may hold some, and writes these rows and the batch as new files; all other files stay. The new manifest is named in ``<path>/current`` last, so readers
see the old table or the new one, and a failed run changes nothing. One writer at a time; replaced files stay for readers of older manifests until ``clean`` removes them.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ranking
from ..operators.columns import q
from ..operators.settle import settled

#: Bits and hashes a key of a file's filter: one of a hundred keys that a file doesn't hold seems to be there.
BITS, HASHES = 10, 7
#: Keys of a batch that are sent to the manifest's rows. Larger batches choose files by their range of keys only.
KEYS = 1_000_000


class Upserted(NamedTuple):
    manifest: str
    kept: int
    rewritten: int
    written: int


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    """A filter of 64-bit hashes."""
    bits = max(8, -(-BITS * len(hashes) // 8) * 8)
    held = np.zeros(bits, bool)
    held[_places(hashes, bits).ravel()] = True
    return np.packbits(held).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes, len(filter_) * 8)
    return (np.frombuffer(filter_, np.uint8)[at >> 3] & (128 >> (at & 7)).astype(np.uint8) > 0).all(axis=1)


def _current(spark: SparkSession, path: str) -> tuple[str, StructType] | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    named = json.loads(spark.read.text(f"{path}/current").first().value)
    return named["manifest"], StructType.fromJson(named["schema"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows. Files of before a column was added give nulls for it."""
    manifest, schema = _current(spark, path)
    files = [r.file for r in spark.read.parquet(manifest).select("file").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: (file, n, low, high, nulls, bloom)."""
    return spark.read.parquet(_current(spark, path)[0])


def _write(rows: DataFrame, path: str, key: str, rows_per_file: int) -> DataFrame:
    """The manifest's rows for new files with ``rows``, by ranges of keys."""
    spark, folder = rows.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    parts = max(1, -(-rows.count() // rows_per_file))
    rows.repartitionByRange(parts, q(key)).sortWithinPartitions(q(key)).write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    made = spark.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_path").alias("file"), q(key).alias("key"))
    # A file has ``rows_per_file`` keys at most, and so has the list of a group.
    each = made.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.bool_or(F.col("key").isNull()).alias("nulls"), F.collect_list(F.when(F.col("key").isNotNull(), F.xxhash64("key"))).alias("hashes"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bloom(np.array(h or [], np.int64)) for h in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary())], ["file", "n", "low", "high", "nulls", "bloom"])

    kind = rows.schema[key].dataType.simpleString()
    return each.mapInArrow(build, f"file string, n long, low {kind}, high {kind}, nulls boolean, bloom binary")


def touched(manifest: DataFrame, batch: DataFrame, key: str) -> list[str]:
    """Files that may hold keys of the batch, which has one row a key."""
    n, low, high, nulls = batch.agg(F.count("*"), F.min(q(key)), F.max(q(key)), F.coalesce(F.bool_or(q(key).isNull()), F.lit(False))).first()
    null = F.col("nulls") & F.lit(nulls)
    if low is None:
        return [r.file for r in manifest.where(null).select("file").collect()]
    near = manifest.where(null | ((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low))))
    if n > KEYS:
        return [r.file for r in near.select("file").collect()]
    rows = batch.where(q(key).isNotNull()).select(q(key).alias("key"), F.xxhash64(q(key)).alias("h")).orderBy("key").collect()
    keys, hashes = [r.key for r in rows], np.array([r.h for r in rows], np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = []
            for lo, hi, null_, filter_ in zip(*(part.column(c).to_pylist() for c in ("low", "high", "null", "bloom")), strict=True):
                some = hashes[bisect_left(keys, lo) : bisect_right(keys, hi)] if lo is not None else hashes[:0]
                found.append(bool(null_) or bool(may_hold(filter_, some).any()))
            yield part.select(["file"]).filter(pa.array(found))

    return [r.file for r in near.select("file", "low", "high", null.alias("null"), "bloom").mapInArrow(look, "file string").collect()]


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, order: Sequence[str] = (), rows_per_file: int = 100_000) -> Upserted:
    """Merges rows into the table: of one key the new row stays, of several new ones the last by ``order`` and then by all columns' values as text. New columns are added; null is a key too."""
    held = _current(spark, path)
    if held:
        new = new.withColumn(key, q(key).cast(held[1][key].dataType))
    batch = settled(ranking.upsert(new.where("false"), new, key, order))
    kept, old = None, []
    if held:
        manifest = spark.read.parquet(held[0])
        old = touched(manifest, batch, key)
        stored = spark.read.schema(held[1]).parquet(*old) if old else spark.createDataFrame([], held[1])
        kept = manifest.where(~F.col("file").isin(old)) if old else manifest
        batch = settled(ranking.upsert(stored, batch, key, order).select(*[c.name for c in held[1]], *[c for c in batch.columns if c not in held[1].names]))
    added = _write(batch, path, key, rows_per_file)
    name = f"{path}/manifests/{uuid.uuid4().hex}"
    (added if kept is None else kept.unionByName(added)).coalesce(8).write.parquet(name)
    spark.createDataFrame([(json.dumps({"manifest": name, "schema": json.loads(batch.schema.json())}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    n = spark.read.parquet(name).count()
    left = 0 if kept is None else kept.count()
    return Upserted(name, left, len(old), n - left)


def clean(spark: SparkSession, path: str) -> int:
    """Removes the files and manifests that the current manifest doesn't name; the number of files removed. No reader may hold an older manifest."""
    java = spark.sparkContext._jvm
    root = java.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    manifest, _ = _current(spark, path)
    plain = lambda f: java.org.apache.hadoop.fs.Path(f).toUri().getPath()
    live = {plain(r.file) for r in spark.read.parquet(manifest).select("file").collect()}
    gone = 0
    for folder in system.listStatus(java.org.apache.hadoop.fs.Path(f"{path}/data")):
        for f in system.listStatus(folder.getPath()):
            if f.getPath().getName().startswith("part-") and f.getPath().toUri().getPath() not in live:
                gone += bool(system.delete(f.getPath(), False))
    for f in system.listStatus(java.org.apache.hadoop.fs.Path(f"{path}/manifests")):
        if f.getPath().toUri().getPath() != plain(manifest):
            system.delete(f.getPath(), True)
    return gone
