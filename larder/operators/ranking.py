"""Deduplication, top-k, sampling and upserts, each with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import q


def _columns(cs: Sequence[str | Column]) -> list[Column]:
    return [q(c) if isinstance(c, str) else c for c in cs]


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order that should be total; null keys are keys."""
    window = Window.partitionBy(*_columns(keys)).orderBy(*_columns(order))
    ranked = df.withColumn(rank or "_rank", F.row_number().over(window)).where(F.col(rank or "_rank") <= n)
    return ranked if rank else ranked.drop("_rank")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Stored and new rows, of one key the last: new rows win, among equally new ones the last by ``order``, then by all columns' values as text; the columns are those of both."""
    both = stored.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_age")]
    return first_by(both, [key], [F.desc("_age"), *(F.desc(f"`{c}`") for c in order), F.desc(F.to_json(F.struct(*(q(c) for c in rest)))) if rest else F.lit(0)]).drop("_age")


def union_preferring(frames: Sequence[DataFrame], key: Column, order: str) -> DataFrame:
    """All frames' rows by column name, of one key the row of the earliest frame, then in ``order``."""
    out = frames[0].withColumn("_from", F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_from", F.lit(k)), allowMissingColumns=True)
    return first_by(out.withColumn("_key", key), ["_key"], ["_from", order]).drop("_from", "_key")


def sample(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """k rows by hash of the id: the same ones for the same seed, whatever the partitions."""
    return df.orderBy(F.xxhash64(q(id_col), F.lit(seed)), q(id_col)).limit(k)


def gumbel_sample(df: DataFrame, id_col: str, score: str, k: int, temperature: float = 1.5, seed: int = 42) -> DataFrame:
    """k rows without replacement with odds by softmax of score / temperature: the largest scores with Gumbel noise from a hash of the id."""
    u = (F.pmod(F.xxhash64(q(id_col), F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return df.orderBy(F.desc(q(score) / temperature - F.log(-F.log(u))), q(id_col)).limit(k)


def weighted_sample(df: DataFrame, id_col: str, weight: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement with odds by weight, by exponential keys from a hash of the id; weights of 0 or less are never taken."""
    u = (F.pmod(F.xxhash64(q(id_col), F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return df.where(q(weight) > 0).orderBy(-F.log(u) / q(weight), q(id_col)).limit(k)


def best_sources(df: DataFrame, id_col: str, kcal: str, amounts: dict[str, float], per_nutrient: int = 30, most: int = 500, least_kcal: float = 1.0) -> DataFrame:
    """(id, picked): the ids that are best for some nutrient by share of its daily amount per kcal, filled up with the densest others.

    ``amounts``: daily amount by nutrient column. ``picked`` is 1 for the first kind. Ties go to the smaller id.
    """
    base = df.where(q(kcal) >= least_kcal).select(q(id_col).alias("id"), q(kcal).alias("kcal"), *(F.coalesce(q(n), F.lit(0.0)).alias(n) for n in amounts))
    share = lambda n, rda: F.col(f"`{n}`") / rda / (F.col("kcal") / 100)
    scores = F.array(*(F.struct(F.lit(n).alias("nutrient"), (share(n, rda) * 100).alias("score")) for n, rda in amounts.items()))
    long = base.select("id", F.inline(scores))
    top = first_by(long.where("score > 0"), ["nutrient"], [F.desc("score"), "id"], per_nutrient).select("id").distinct().withColumn("picked", F.lit(1))
    density = sum((share(n, rda) for n, rda in amounts.items()), F.lit(0.0))
    all_ = base.select("id", density.alias("density")).join(top, "id", "left").withColumn("picked", F.coalesce("picked", F.lit(0)))
    return all_.orderBy(F.desc("picked"), F.desc("density"), "id").limit(most).select("id", "picked")


def usual_sizes(df: DataFrame, group: str, size: str, most: int = 3) -> DataFrame:
    """(group, size, n, n_sizes, suspicious): each group's most frequent sizes; groups of more sizes are suspicious."""
    counts = df.where(q(size).isNotNull()).groupBy(q(group).alias("group"), q(size).alias("size")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("n_sizes", F.count("*").over(Window.partitionBy("group")))
    return first_by(counts, ["group"], [F.desc("n"), "size"], most).withColumn("suspicious", F.col("n_sizes") > most)


def one_per_size(df: DataFrame, group: str, size: str, id_col: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, suspicious): one row of each of a group's usual sizes, and one of rows without a size; suspicious groups are listed too."""
    usual = usual_sizes(df, group, size, most)
    firsts = first_by(df, [group, size], [id_col])
    kept = firsts.join(usual.select(F.col("group").alias(group), F.col("size").alias(size), F.lit(True).alias("_usual")), [group, size], "left")
    kept = kept.where(F.col("_usual") | q(size).isNull()).drop("_usual")
    return kept, usual.where("suspicious").select("group", "n_sizes").distinct()
