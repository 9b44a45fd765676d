"""Sharding by Karmarkar-Karp differencing.

Indivisible groups (equal texts) become partial partitions with one filled part; the two of largest spread are combined with their parts oppositely
ordered until one is left. On one machine this takes one entry a group, so at scale the largest ``heads`` groups enter
one by one and all others enter as cells: unions of groups chosen by hash, whose expected sizes fall by halves down to a few
groups. The cells' sizes span many orders of magnitude, so differencing can cancel what the heads leave over; the
number of entries is bounded and only their sums reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, width

LEVELS, CELLS = 24, 64


def differencing(sizes: Sequence[int], parts: int) -> list[int]:
    """The part of every size, by Karmarkar-Karp's differencing method for ``parts`` parts."""
    if not sizes:
        return []
    # A partial partition: sums in falling order, each with a tree of its members (an index, or two trees).
    heap = [(-s, n, (s, *[0] * (parts - 1)), (n, *[None] * (parts - 1))) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        both = sorted(((x + y, k, (t, u) if t is not None and u is not None else t if u is None else u) for k, (x, y, t, u) in enumerate(zip(a, reversed(b), in_a, reversed(in_b), strict=True))), key=lambda p: (-p[0], p[1]))
        sums = tuple(p[0] for p in both)
        heapq.heappush(heap, (sums[-1] - sums[0], count, sums, tuple(p[2] for p in both)))
        count += 1
    out = [0] * len(sizes)
    for part, tree in enumerate(heap[0][3]):
        rest = [tree]
        while rest:
            node = rest.pop()
            if isinstance(node, tuple):
                rest.extend(node)
            elif node is not None:
                out[node] = part
    return out


def _cell(key: Column) -> Column:
    """A cell's number: level (halving odds) and one of CELLS within it."""
    mix = F.xxhash64(key, F.lit("cell"))
    level = F.least(F.lit(LEVELS - 1), F.bit_count(mix.bitwiseXOR(mix - 1)) - 1)
    return level * CELLS + F.pmod(F.xxhash64(key, F.lit("row")), F.lit(CELLS))


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, heads: int = 4096) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): one row a row of ``df``, equal texts together, bytes near equal.

    Size: UTF-8 bytes of the text plus 1; a null text has no bytes, so size 1 and the check sum of nothing, and is of the group of empty texts. ``law`` is
    "bytes", so ``grown_shard`` is null. ``slot`` numbers a shard's rows from 0 without gaps, by a hash bucket of the id, then id. If one
    group is larger than an equal share, its shard is that much larger. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.unhex(F.md5(text)), F.unhex(F.lpad(F.hex(F.crc32(text)), 8, "0")))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), key.alias("key"))
    rows = stage(rows, "sizes")
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    top = groups.orderBy(F.desc("size"), "key").limit(heads)
    largest = top.collect()
    spark = df.sparkSession
    known = spark.createDataFrame([(bytes(r.key),) for r in largest], "key binary")
    rest = groups.join(F.broadcast(known), "key", "left_anti")  # ``heads`` keys at most
    cells = rest.groupBy(_cell(F.col("key")).alias("cell")).agg(F.sum("size").alias("size")).orderBy("cell").collect()
    law = differencing([r.size for r in largest] + [r.size for r in cells], shards)
    of_head = spark.createDataFrame([(bytes(r.key), s) for r, s in zip(largest, law, strict=False)], "key binary, head_shard int")
    of_cell = spark.createDataFrame([(r.cell, s) for r, s in zip(cells, law[len(largest) :], strict=True)], "cell long, cell_shard int")
    # Both are bounded: ``heads`` rows and LEVELS * CELLS rows.
    placed = rows.join(F.broadcast(of_head), "key", "left").withColumn("cell", _cell(F.col("key")).cast("long")).join(F.broadcast(of_cell), "cell", "left")
    buckets = width(spark) * 4
    placed = placed.select("id", "size", "crc", "key", F.coalesce("head_shard", "cell_shard").alias("shard"), F.pmod(F.xxhash64("id", "key"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "key")) - 1
    out = placed.withColumn("place", place).join(F.broadcast(starts), ["shard", "bucket"])  # shards * buckets rows
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
