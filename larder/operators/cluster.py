"""Order-dependent clustering: rows of a block, in a total order, join the first or best cluster that fits or found a new one.

What can join at all is found first, by joins: similar names by their grams, so no block is compared pair by pair. Where only the best name before counts, chains of them
end at the founders and nothing is gathered. Where founders decide, a block's rows stream through a task in order, many blocks one after another, and
only founders that may still be met are kept. Rows that are equal in what decides follow the first of them where they always join alike.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import floor_for
from . import similar
from .columns import q
from .ranking import first_by
from .settle import roots, settled


class Leaders:
    """Clusters of rows (None: missing) where a row joins the first cluster all of whose shared values are within ``share`` of the larger; a cluster takes over values it lacks.

    A value within ``share`` of another is in the same or a neighbouring step of its logarithm. Clusters are listed by step for each column, those that lack the column beside them; a row is compared with the lists of the column that gives the fewest.
    """

    def __init__(self, columns: int, share: float = 0.10):
        self.share, self.step = share, -math.log(1 - share)
        self.heads: list[list[float | None]] = []
        self.steps: list[dict[int, list[int]]] = [{} for _ in range(columns)]
        self.lacking: list[dict[int, None]] = [{} for _ in range(columns)]

    def _at(self, value: float) -> int:
        return math.floor(math.log(max(abs(value), 1e-9)) / self.step)

    def _listed(self, row: Sequence[float | None]) -> Iterator[int]:
        fewest = None
        for c, x in enumerate(row):
            if x is not None:
                at = self._at(x)
                lists = [near for k in (at - 1, at, at + 1) if (near := self.steps[c].get(k))]
                n = len(self.lacking[c]) + sum(map(len, lists))
                if fewest is None or n < fewest[0]:
                    fewest = n, lists, self.lacking[c]
        return iter(range(len(self.heads))) if fewest is None else iter(sorted([*fewest[2], *(k for near in fewest[1] for k in near)]))

    def join(self, row: Sequence[float | None]) -> int:
        """The row's cluster, numbered in order of founding."""
        for k in self._listed(row):
            head = self.heads[k]
            if all(x is None or y is None or abs(x - y) <= self.share * max(abs(x), abs(y), 1e-9) for x, y in zip(row, head, strict=True)):
                for c, x in enumerate(row):
                    if head[c] is None and x is not None:
                        head[c] = x
                        del self.lacking[c][k]
                        self.steps[c].setdefault(self._at(x), []).append(k)
                return k
        k = len(self.heads)
        self.heads.append(list(row))
        for c, x in enumerate(row):
            if x is None:
                self.lacking[c][k] = None
            else:
                self.steps[c].setdefault(self._at(x), []).append(k)
        return k


def lead(values: np.ndarray, share: float = 0.10) -> list[int]:
    """Clusters of rows (nan: missing) in order, by ``Leaders``."""
    leaders = Leaders(values.shape[1], share)
    return [leaders.join([None if math.isnan(x) else x for x in row]) for row in values.tolist()]


class Taxonomy:
    """Clusters where a row joins the first of the ``candidates`` most similar founders whose values fit. Of a name's founders only the first ``candidates`` can be among them."""

    def __init__(self, floors: Sequence[float], share: float = 0.15, candidates: int = 5):
        self.floors, self.share, self.candidates = floors, share, candidates
        self.founders: dict[int, list[tuple[int, Sequence[float | None]]]] = {}
        self.n = 0

    def join(self, name: int, near: Sequence[tuple[float, int]], row: Sequence[float | None]) -> int:
        """The row's cluster, numbered in order of founding. ``near``: (score, name) of the names alike, the row's own among them."""
        listed = heapq.nsmallest(self.candidates, ((-score, k, values) for score, other in near for k, values in self.founders.get(other, ())), key=lambda x: x[:2])
        for _, k, values in listed:
            if all(x is None or y is None or abs(x - y) <= max(f, self.share * max(x, y)) for x, y, f in zip(row, values, self.floors, strict=True)):
                return k
        held = self.founders.setdefault(name, [])
        if len(held) < self.candidates:
            held.append((self.n, row))
        self.n += 1
        return self.n - 1


def _rows(df: DataFrame, block: Sequence[Column], id_col: str, use: Sequence[str]) -> DataFrame:
    """(_id, _g, used columns); ``_g`` names the block, null parts included."""
    return df.select(q(id_col).alias("_id"), F.to_json(F.struct(*(b.alias(f"b{k}") for k, b in enumerate(block)))).alias("_g"), *(q(c) for c in use))


def _order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [*(F.asc_nulls_last(q(c)) if up else F.desc_nulls_last(q(c)) for c, up in order), F.asc("_id")]


def _followed(rows: DataFrame, same: Sequence[str], order: Sequence[tuple[str, bool]], solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_id, _first, cluster, ...): the rows with what ``solve`` says of the first row of those that are equal in block and ``same``."""
    keyed = rows.withColumn("_key", F.struct("_g", *map(q, same)))
    heads = first_by(keyed, ["_key"], _order(order))
    led = heads.select(F.col("_id").alias("_first"), F.col("_key").alias("_head")).join(solve(heads.drop("_key")).withColumnRenamed("_id", "_first"), "_first")
    return keyed.select("_id", "_key").join(led, F.col("_key").eqNullSafe(F.col("_head"))).drop("_key", "_head")


def _streamed(rows: DataFrame, order: Sequence[tuple[str, bool]], use: Sequence[str], start: Callable[[], Callable[[list], int]], kind: str) -> DataFrame:
    """(_id, cluster): each block's rows in order through ``start()``'s function of the used columns, which numbers clusters in order of founding; the cluster is the id of its first row.

    A task has many blocks, one after another, and holds what the function of one block keeps.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, join, first = None, None, []
        for batch in batches:
            out = []
            ids = batch.column(0)
            for g, i, row in zip(batch.column(1).to_pylist(), ids.to_pylist(), zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True), strict=True):
                if join is None or g != group:
                    group, join, first = g, start(), []
                k = join(row)
                if k == len(first):
                    first.append(i)
                out.append(first[k])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, ids.type)], ["_id", "cluster"])

    dealt = rows.repartition("_g").sortWithinPartitions("_g", *_order(order))
    return dealt.select("_id", "_g", *map(q, use)).mapInArrow(work, f"_id {kind}, cluster {kind}")


def by_tolerance(df: DataFrame, keys: Sequence[str], id_col: str, nutrients: Sequence[str], order: str, share: float = 0.10) -> DataFrame:
    """(id, cluster): within equal keys (null ones included), rows in falling ``order``, then rising id, join the first cluster within ``share``. Rows equal in all nutrients follow the first of them."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = _rows(df.withColumn("_order", q(order)).withColumns({n: F.when(~F.isnan(q(n).cast("double")), q(n).cast("double")) for n in nutrients}), [q(k) for k in keys], id_col, [*nutrients, "_order"])

    def start() -> Callable[[list], int]:
        return Leaders(len(nutrients), share).join

    found = _followed(rows, nutrients, [("_order", False)], lambda heads: _streamed(heads, [("_order", False)], nutrients, start, kind))
    return found.select(F.col("_id").alias(id_col), "cluster")


def by_spelling(df: DataFrame, block: Sequence[Column], id_col: str, name: str, least: float = 93, order: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    """(id, cluster, score): within a block, in ``order`` and by id, a name joins the cluster of the most similar name before it, the first of equals, if that is ``least`` or more; the score is that similarity, null for founders. Null names are empty ones; rows of a name follow its first with a score of 100.

    All pairs of names that are similar enough come from ``similar.pairs``. Each name points to the best before it; the ends of these chains are the founders.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = _rows(df, block, id_col, [name, *(c for c, _ in order if c != name)])

    def solve(heads: DataFrame) -> DataFrame:
        heads = settled(heads.withColumn("_at", F.row_number().over(Window.partitionBy("_g").orderBy(*_order(order)))))
        alike = similar.pairs(heads.select(F.col("_id").alias("id"), q(name).alias("text"), "_g"), ["_g"], least)
        places = [heads.select(F.col("_id").alias(i), F.col("_at").alias(f"_{i}_at")) for i in "ab"]
        placed = alike.join(places[0], "a").join(places[1], "b")
        later = F.col("_a_at") > F.col("_b_at")
        pointed = placed.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("parent"), F.least("_a_at", "_b_at").alias("_before"), "score")
        best = settled(first_by(pointed, ["id"], [F.desc("score"), "_before"]).select("id", "parent", "score"))
        ends = roots(best.select("id", "parent")).join(best.select("id", "score"), "id")
        return heads.select("_id").join(ends.withColumnRenamed("id", "_id"), "_id", "left").select("_id", F.coalesce("root", "_id").cast(kind).alias("cluster"), "score")

    found = _followed(rows, [name], order, solve)
    return found.select(F.col("_id").alias(id_col), "cluster", F.when(F.col("_id").eqNullSafe(F.col("_first")), F.col("score")).otherwise(100.0).alias("score"))


def by_taxonomy(df: DataFrame, block: Sequence[Column], id_col: str, name: str, nutrients: Sequence[str], least: float = 85) -> DataFrame:
    """(id, cluster): within a block, by id, a row joins the first of the five most similar founders of ``least`` or more, the first of equals, whose nutrients are compatible. Null names are empty ones.

    Rows have their names' similar names with them; a task compares values only.
    """
    kind = df.schema[id_col].dataType.simpleString()
    floors = [floor_for(n) for n in nutrients]
    rows = _rows(df.withColumns({n: F.when(~F.isnan(q(n).cast("double")), q(n).cast("double")) for n in nutrients}), block, id_col, [name, *nutrients]).withColumn("_name", F.coalesce(q(name), F.lit("")))
    names = settled(rows.select("_g", "_name").distinct().withColumn("id", F.monotonically_increasing_id()))
    alike = similar.pairs(names.select("id", F.col("_name").alias("text"), "_g"), ["_g"], least)
    both = alike.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(alike.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    listed = both.groupBy("id").agg(F.collect_list(F.struct("score", "other")).alias("_others"))
    known = names.join(listed, "id", "left").select("_g", "_name", F.col("id").alias("_number"), F.array_append(F.coalesce("_others", F.array().cast("array<struct<score:double,other:bigint>>")), F.struct(F.lit(100.0).alias("score"), F.col("id").alias("other"))).alias("_near"))

    def start() -> Callable[[list], int]:
        solver = Taxonomy(floors)
        return lambda row: solver.join(row[0], [(x["score"], x["other"]) for x in row[1]], row[2:])

    found = _streamed(rows.join(known, ["_g", "_name"]), [], ["_number", "_near", *nutrients], start, kind)
    return found.withColumnRenamed("_id", id_col)


def average_linkage(sums: np.ndarray, size: np.ndarray, most: float = 0.10) -> list[int]:
    """Agglomerative clusters by average cosine distance, merged while the least distance is ``most`` or less. ``sums``, ``size``: the sum of each one's unit vectors and their number.

    The average distance of two clusters follows from the sums of their unit vectors, and each cluster keeps its nearest one, so no matrix of all pairs is
    held. A merge never brings two clusters nearer than their parts were, so only those whose nearest was merged look anew.
    """
    n, sums, size = len(sums), sums.copy(), size.astype(np.float64)
    label, alive = np.arange(n), np.ones(n, bool)
    near, least = np.zeros(n, np.int64), np.full(n, np.inf)

    def look(rows: np.ndarray) -> None:
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            dist = 1 - (sums[part] @ sums.T) / size[part, None] / size
            dist[:, ~alive] = np.inf
            dist[np.arange(len(part)), part] = np.inf
            near[part] = dist.argmin(axis=1)
            least[part] = dist[np.arange(len(part)), near[part]]

    look(np.arange(n))
    for _ in range(n - 1):
        i = int(np.argmin(least))
        if least[i] > most:
            break
        i, j = sorted((i, int(near[i])))
        sums[i] += sums[j]
        size[i] += size[j]
        alive[j], least[j] = False, np.inf
        label[label == j] = i
        look(np.nonzero(alive & ((near == i) | (near == j) | (np.arange(n) == i)))[0])
    return label.tolist()


def _nearest_clusters(state: DataFrame, tile: int) -> DataFrame:
    """(id, near, far): for each cluster that is to ``look``, the other of its block at the least mean distance, ties by the two ids. ``state``: (id, _g, sums, size, look).

    A block's clusters are dealt to tiles; tiles that look meet all tiles of their block, a pair a task.
    """
    sizes = state.groupBy("_g").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    dealt = state.join(sizes, "_g").withColumn("_tile", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    asked = dealt.where("look").select("id", "_g", "sums", "size", F.col("_tile").alias("a"), every.alias("b"), F.lit(True).alias("asks"))
    known = dealt.select("id", "_g", "sums", "size", every.alias("a"), F.col("_tile").alias("b"), F.lit(False).alias("asks"))

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
        sums = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        mean = sums / size[:, None]
        own, other = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(own), 512):
            part = own[at : at + 512]
            like = mean[part] @ mean[other].T
            like[ids[part][:, None] == ids[other][None, :]] = -np.inf
            i, j = np.nonzero((like >= like.max(axis=1, keepdims=True, initial=-np.inf) - 1e-9) & (like > -np.inf))
            x, y = part[i], other[j]
            far = 1 - np.cumsum(sums[x] * sums[y], axis=1)[:, -1] / (size[x] * size[y])  # the same for both, to the last bit
            order = np.lexsort((np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y]), far, x))
            first = order[np.unique(x[order], return_index=True)[1]]
            out.append((ids[x[first]], ids[y[first]], far[first]))
        i, near, far = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"id": pa.array(i, pa.int64()), "near": pa.array(near, pa.int64()), "far": pa.array(far, pa.float64())})

    found = asked.unionByName(known).groupBy("_g", "a", "b").applyInArrow(meet, "id long, near long, far double")
    return first_by(found, ["id"], ["far", F.least("id", "near"), F.greatest("id", "near")])


def _linked_whole(rows: DataFrame, most: float) -> DataFrame:
    """(id, parent) of the merged: each block in one task."""

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("id", kind="stable").reset_index(drop=True)
        k = np.array(average_linkage(np.stack(table["sums"].to_list()), table["size"].to_numpy(), most))
        ids = table["id"].to_numpy()
        first = pd.Series(ids).groupby(k).transform("first").to_numpy()
        return pd.DataFrame({"id": ids, "parent": first})[ids != first]

    return rows.select("id", "_g", "sums", "size").groupBy("_g").applyInPandas(solve, "id long, parent long")


def linked(rows: DataFrame, most: float, whole: int = 4096, tile: int = 2048) -> DataFrame:
    """(id, root) of all rows that are merged into others by average linkage up to the distance ``most``. ``rows``: (id, _g, sums, size), the sum of a cluster's unit vectors and their number.

    Blocks of up to ``whole`` clusters are solved in one task. Others go in rounds until they are as small: a merge never brings two clusters nearer than their parts were, so all pairs of clusters
    that are each other's nearest merge at once, and a cluster whose nearest isn't merged keeps it. Clusters whose nearest is farther than ``most`` are final and leave.
    """
    count = rows.groupBy("_g").agg((F.count("*") > whole).alias("_large"))
    sized = settled(rows.select("id", "_g", "sums", "size").join(count, "_g"))
    small = _linked_whole(sized.where("not _large"), most)
    if not sized.where("_large").limit(1).count():
        return small.withColumnRenamed("parent", "root")
    steps = [small]
    state = sized.where("_large").select("id", "_g", "sums", "size", F.lit(True).alias("look"), F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("far"))
    while True:
        fresh = _nearest_clusters(state, tile)
        renewed = state.where("look").drop("near", "far").join(fresh, "id").select(*state.columns).unionByName(state.where("not look"))
        state = settled(renewed.where(F.col("far") <= most))
        back = state.select(F.col("id").alias("near"), F.col("near").alias("_back"))
        pairs = settled(state.join(back, "near").where("_back = id and id < near").select("id", F.col("near").alias("gone")))
        steps.append(pairs.select(F.col("gone").alias("id"), F.col("id").alias("parent")))
        into = pairs.select("id", "id").toDF("id", "_into").unionByName(pairs.select("gone", "id").toDF("id", "_into"))
        placed = state.join(into, "id", "left")
        kept = placed.where("_into is null").join(into.select(F.col("id").alias("near"), F.lit(True).alias("_moved")), "near", "left")
        kept = kept.select("id", "_g", "sums", "size", F.coalesce("_moved", F.lit(False)).alias("look"), "near", "far")
        other = placed.where("_into <> id").select("_into", F.col("sums").alias("_sums"), F.col("size").alias("_size"))
        joined = placed.where("_into = id").join(other, "_into").select("id", "_g", F.zip_with("sums", "_sums", lambda x, y: x + y).alias("sums"), (F.col("size") + F.col("_size")).alias("size"), F.lit(True).alias("look"), "near", "far")
        state = settled(kept.unionByName(joined))
        most_left = state.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
        if most_left <= whole:
            steps.append(_linked_whole(state, most))
            return roots(reduce(DataFrame.unionByName, steps))


def by_meaning(df: DataFrame, block: Sequence[Column], id_col: str, vector: str, most: float = 0.10, whole: int = 4096) -> DataFrame:
    """(id, cluster): average-linkage clusters of cosine distance ``most`` within blocks. Equal vectors of a block are one, with their number as its weight. Ids are whole numbers.

    A block of up to ``whole`` distinct vectors is solved in one task, larger ones in rounds in which no task has more than two tiles of vectors (``linked``). Both give the same clusters, but for ties of distance.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = _rows(df, block, id_col, [vector]).withColumn("_key", F.struct("_g", q(vector).alias("_v")))
    heads = rows.groupBy("_key").agg(F.min("_id").cast("long").alias("id"), F.count("*").cast("double").alias("size"))
    heads = settled(heads.select("id", "size", F.col("_key._g").alias("_g"), F.col("_key._v").cast("array<double>").alias("_v"), "_key"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    summed = heads.withColumn("_share", F.col("size") / F.greatest(length, F.lit(1e-12))).select("id", "_g", F.transform("_v", lambda x: x * F.col("_share")).alias("sums"), "size")
    found = heads.select("id", F.col("_key").alias("_head")).join(linked(summed, most, whole), "id", "left").select("_head", F.coalesce("root", "id").cast(kind).alias("cluster"))
    return rows.join(found, F.col("_key").eqNullSafe(F.col("_head"))).select(F.col("_id").alias(id_col), "cluster")
