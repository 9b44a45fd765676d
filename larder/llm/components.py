"""Connected components of a graph that is too large for one machine.

Each round hooks every vertex to the neighbour (or itself) of least hash, shortens the chains by
two jumps, and replaces the edges' ends by the hooks. Hash order makes long ascending paths unlikely,
so the number of vertices with edges falls by a constant factor a round. Minima are aggregated map-side and the
other steps are plain equi-joins, so a hub with many edges is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage, width


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: (u long, v long). Returns (node, root) for every node that has an edge to another one.

    Loops, repeated edges and both directions are allowed. An edge with a null end is ignored; an empty table gives none.
    """
    live = stage(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    # Rounds only shrink the graph, so as many tasks as its edges fill are enough for all that follows.
    tasks = min(width(edges.sparkSession), 1 + live.count() // 50_000)
    kept = lambda df, name: stage(df.coalesce(tasks), name)
    roots = None
    for _ in range(rounds):
        both = live.select(F.col("u").alias("node"), F.col("v").alias("near")).unionAll(live.select("v", "u"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hooks = both.groupBy("node").agg(F.min(order("near")).alias("near"))
        hooks = kept(hooks.select("node", F.least(order("node"), F.col("near"))["id"].alias("parent")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            hooks = hooks.join(above, "parent").select("node", F.col("top").alias("parent"))
        hooks = kept(hooks, "hooks")
        if roots is None:
            roots = hooks.select("node", F.col("parent").alias("root"))
        else:
            step = hooks.select(F.col("node").alias("root"), "parent")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
            roots = kept(roots, "roots")
        at = lambda c: hooks.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))  # noqa: E731, B023
        moved = live.join(at("u"), "u").join(at("v"), "v").where("pu <> pv")
        live = kept(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if live.isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")
