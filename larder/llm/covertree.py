"""Exact top-k search by inner product with two cover trees.

Data and queries are dealt to blocks; each block becomes a cover tree: a node's children are points of it, far from each other, and every point
below a node is within its covering radius. A pair of blocks is searched from the two roots down. The inner product of any query below q and any vector below d
is at most <q, d> + |q| r_d + |d| r_q + r_q r_d, so a pair of nodes is dropped once that is below the worst kth score of the query node's
queries. Block results are merged by rank.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

LEAF, FAN = 64, 16


class CoverTree:
    """Points in tree order with, for each node, its center, covering radius, range of points and children."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(points)
        self.center_points = points[self.center] if len(points) else points

    def _node(self, center: int, radius: float, lo: int, hi: int) -> int:
        self.center.append(center)
        self.radius.append(radius)
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.center) - 1

    def _grow(self, points: np.ndarray) -> None:
        dist = lambda rows, c: np.sqrt(((points[rows] - points[c]) ** 2).sum(axis=1))
        far = dist(self.order, 0)
        todo = [(self._node(0, float(far.max()), 0, len(points)), far)]
        while todo:
            node, near = todo.pop()
            lo, hi = self.span[node]
            if hi - lo <= LEAF or self.radius[node] == 0:
                continue
            rows, scale = self.order[lo:hi], self.radius[node] / 2
            centers, near, owner = [self.center[node]], near.copy(), np.zeros(hi - lo, np.int64)
            # The farthest point becomes a center until all are within half the radius, or there are FAN of them.
            while len(centers) < FAN and near.max() > scale:
                c = int(rows[np.argmax(near)])
                new = dist(rows, c)
                closer = new < near
                owner[closer], near[closer] = len(centers), new[closer]
                centers.append(c)
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi], near, owner = rows[by], near[by], owner[by]
            ends = np.searchsorted(owner, np.arange(len(centers) + 1))
            for k, c in enumerate(centers):
                a, b = int(ends[k]), int(ends[k + 1])
                if a < b:
                    child = self._node(c, float(near[a:b].max()), lo + a, lo + b)
                    self.children[node].append(child)
                    todo.append((child, near[a:b]))


def search(queries: CoverTree, q: np.ndarray, q_row: np.ndarray, data: CoverTree, d: np.ndarray, d_row: np.ndarray, d_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, data index, score) of every query's k best, other rows only, ties to the smaller id."""
    qp, dp = q[queries.order], d[data.order]
    rows_q, rows_d, ids = q_row[queries.order], d_row[data.order], d_id[data.order]
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1]) < 2**53
    if not exact:
        qp, dp = qp.astype(np.int64), dp.astype(np.int64)
    cq, cd = queries.center_points, data.center_points
    rq, rd = np.array(queries.radius)[:, None], np.array(data.radius)[None, :]
    size = lambda x: np.sqrt((x * x).sum(axis=1))
    bound = cq @ cd.T + size(cq)[:, None] * rd + size(cd)[None, :] * rq + rq * rd
    bound += 1e-6 * (1 + np.abs(bound) + size(cq)[:, None] * size(cd)[None, :])  # rounding never prunes
    low = np.iinfo(np.int64).min
    best = np.full((len(qp), k), low)
    best_at = np.full((len(qp), k), -1)
    best_id = np.full((len(qp), k), np.iinfo(np.int64).max)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        lo, hi = queries.span[a]
        if best[lo:hi, -1].min() > bound[a, b]:
            continue
        below_q, below_d = queries.children[a], data.children[b]
        if below_q and (not below_d or queries.radius[a] >= data.radius[b]):
            todo += sorted(((c, b) for c in below_q), key=lambda p: bound[p])
        elif below_d:
            todo += sorted(((a, c) for c in below_d), key=lambda p: bound[p])
        else:
            for x in range(*data.span[b], 4096):
                y = min(x + 4096, data.span[b][1])
                score = np.rint(qp[lo:hi] @ dp[x:y].T).astype(np.int64) if exact else qp[lo:hi] @ dp[x:y].T
                score = np.where(rows_q[lo:hi, None] == rows_d[None, x:y], low, score)
                some = np.nonzero((score >= best[lo:hi, -1:]).any(axis=1))[0]
                if len(some) == 0:
                    continue
                at = np.where(score[some] == low, -1, np.arange(x, y))
                name = np.where(at < 0, np.iinfo(np.int64).max, ids[x:y])
                score, at, name = (np.concatenate([o[lo + some], n], axis=1) for o, n in ((best, score[some]), (best_at, at), (best_id, name)))
                top = np.lexsort((name, -np.maximum(score, low + 1)), axis=-1)[:, :k]
                for o, n in ((best, score), (best_at, at), (best_id, name)):
                    o[lo + some] = np.take_along_axis(n, top, axis=1)
    i, j = np.nonzero(best_at >= 0)
    return queries.order[i], data.order[best_at[i, j]], best[i, j]


def whole_components(vector: Column, scale: float = 256) -> Column:
    """array<bigint> floor(scale * x), null where the vector is null or empty or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when((F.size(vector) > 0) & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k other rows of largest integer inner product.

    Ties go to the smaller id, rows of one id are separate candidates. Vectors that are null, empty or hold null or
    non-finite components take no part; vectors of other lengths than the query's aren't candidates; rows without an id take no part. A query without candidates has no rows.
    ``block``, ``query_block``: rows a tree holds, about.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), whole_components(F.col(vector_col), scale).alias("v"), queries.alias("query"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows.where("v is not null and id is not null").withColumn("dim", F.size("v")), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("query")).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))

    def trees(part: DataFrame, count: int, side: int) -> DataFrame:
        def work(table: pa.Table) -> pa.Table:
            dim = table.column("dim")[0].as_py()
            table = table.sort_by("row")
            points = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            packed = pickle.dumps((CoverTree(points), points, table.column("row").to_numpy(), table.column("id").to_numpy()))
            return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1), "side": pa.array([side], pa.int32()), "tree": pa.array([packed], pa.binary())})

        dealt = part.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")).select("dim", "block", "row", "id", "v")
        return stage(dealt.repartition(min(count, 4096), "dim", "block").groupBy("dim", "block").applyInArrow(work, "dim int, block int, side int, tree binary"), "trees")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    data, asked = trees(rows, blocks, 0), trees(rows.where("query"), query_blocks, 1)
    sent = data.select("dim", F.col("block").alias("d"), each(query_blocks).alias("q"), "side", "tree").unionByName(asked.select("dim", each(blocks).alias("d"), F.col("block").alias("q"), "side", "tree"))

    def meet(table: pa.Table) -> pa.Table:
        sides = dict(zip(table.column("side").to_pylist(), table.column("tree").to_pylist(), strict=True))
        if len(sides) < 2:
            none = pa.array([], pa.int64())
            return pa.table({c: none for c in ("query_row", "query_id", "row", "vec_id", "score")})
        (dt, d, d_row, d_id), (qt, q, q_row, q_id) = pickle.loads(sides[0]), pickle.loads(sides[1])
        i, j, score = search(qt, q, q_row, dt, d, d_row, d_id, k)
        return pa.table({"query_row": q_row[i], "query_id": q_id[i], "row": d_row[j], "vec_id": d_id[j], "score": score})

    pairs = min(blocks * query_blocks, 8192)
    found = sent.repartition(pairs, "dim", "d", "q").groupBy("dim", "d", "q").applyInArrow(meet, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
