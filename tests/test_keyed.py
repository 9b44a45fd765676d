import random

import numpy as np
from pyspark.sql import functions as F

from larder.sources import keyed


def test_bloom():
    rng = np.random.default_rng(1)
    held, other = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(-(1 << 62), 1 << 62, 5000)
    made = keyed.bloom(held)
    assert keyed.may_hold(made, held).all() and keyed.may_hold(made, other).mean() < 0.02
    assert not keyed.may_hold(keyed.bloom(held[:0]), other).any()


def test_untouched_files_stay(spark, tmp_path):
    """A batch of 100 keys into 200 files: those of its keys alone are rewritten, and new keys rewrite none but by a filter's error."""
    path = str(tmp_path / "table")
    first = spark.range(20_000).select((F.col("id") * 2).alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
    made = keyed.upsert(spark, path, first, "k", rows_per_file=100)
    assert made.kept == made.rewritten == 0 and made.written >= 200
    before = {r.file for r in keyed.files(spark, path).collect()}
    keys = random.Random(1).sample(range(20_000), 100)
    batch = spark.createDataFrame([(2 * k, f"new {k}") for k in keys], "k int, x string")
    second = keyed.upsert(spark, path, batch, "k", rows_per_file=100)
    assert 0 < second.rewritten < 100 and second.kept == len(before) - second.rewritten
    after = {r.file for r in keyed.files(spark, path).collect()}
    assert len(before & after) == second.kept
    want = {2 * k: None for k in range(20_000)} | {2 * k: f"new {k}" for k in keys}
    got = {r.k: r.x for r in keyed.read(spark, path).collect()}
    assert got.keys() == want.keys() and all(got[k] == x for k, x in want.items() if x) and keyed.read(spark, path).count() == 20_000
    third = keyed.upsert(spark, path, spark.range(300).select((F.col("id") * 120 + 1).alias("k"), F.lit("odd").alias("x")), "k", rows_per_file=100)
    assert third.rewritten < 20 and keyed.read(spark, path).count() == 20_300
    assert keyed.clean(spark, path) > 0 and keyed.read(spark, path).count() == 20_300


def test_as_a_plain_upsert(spark, tmp_path, monkeypatch):
    """Random batches with nulls, repeats, new columns and keys of text, against a dictionary; also with batches that go by ranges alone."""
    for size in (10**6, 3):
        monkeypatch.setattr(keyed, "KEYS", size)
        path, want, rng = str(tmp_path / f"t{size}"), {}, random.Random(size)
        for round_ in range(4):
            rows = [(rng.choice([None, *(f"k{n:03}é" for n in range(60))]), rng.randint(0, 9), round_) for _ in range(25)]
            columns = "k string, v int" + (", r int" if round_ > 1 else "")
            df = spark.createDataFrame([r[: 3 if round_ > 1 else 2] for r in rows], columns)
            keyed.upsert(spark, path, df, "k", ["v"], rows_per_file=7)
            last = {}
            for k, v, r in rows:
                last[k] = max(last.get(k, (-1, None)), (v, r if round_ > 1 else None), key=lambda x: x[0])
            want |= last
        got = {r.k: (r.v, r.r) for r in keyed.read(spark, path).collect()}
        assert got == want and keyed.read(spark, path).count() == len(want)
        assert keyed.files(spark, path).agg(F.max("n")).first()[0] <= 7
        keyed.upsert(spark, path, spark.createDataFrame([], "k string, v int"), "k")
        assert keyed.read(spark, path).count() == len(want)
