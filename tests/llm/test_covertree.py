import numpy as np
from pyspark.sql import functions as F

from larder.llm import covertree
from larder.llm.queries import ORACLES, QUERIES

from .oracle import same


def test_sql(spark):
    assert same(spark, QUERIES["op6_top_k"], ORACLES["op6_top_k"], "/root/testdata/sf0.1") == 200


def test_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(9, 4))
    rows = [(k, [float(x) for x in np.round(base[k % 9] + (k % 5) * 0.001, 3)]) for k in range(400)]
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan"), 0.0, 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (50, [9.0, 9.0, 9.0, 9.0]), (550, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = covertree.top_k(df, F.col("vec_id") % 50 == 0, block=100, query_block=5)
    use = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(use):
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(use) if m != n and len(v) == len(q))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert covertree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 1, (300, 3)) for c in (-50, 0, 50)])
    tree = covertree.CoverTree(points)
    for c, r, (lo, hi) in zip(tree.center, tree.radius, tree.span, strict=True):
        assert np.sqrt(((points[tree.order[lo:hi]] - points[c]) ** 2).sum(axis=1)).max() <= r + 1e-9
    assert sorted(tree.order) == list(range(900))
