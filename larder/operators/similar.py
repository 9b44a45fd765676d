"""Exact similarity joins of names by token-sorted ratio, without comparing all pairs.

Two sorted texts of n and m characters reach a ratio only if their longest common subsequence has L characters, so that they have at least L - (q - 1) (n + m - 2 L) - (q - 1) grams of q characters in
common. Ordered from the rarest gram on, two lists that have c of g grams in common share one of the first g - c + 1. These prefixes are joined by gram, pairs of impossible lengths go, and
the rest is compared exactly. Names of lengths that needn't share a gram are joined by length instead.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import sorted_ratio
from .columns import q

#: What ``str.split`` parts at.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(name, SPACES), lambda w: w != "")), " ")


@cache
def common(n: int, m: int, least: float) -> int:
    """The fewest characters of a common subsequence with which texts of n and m characters reach ``least``; more than either has if they can't."""
    if n + m == 0:
        return 0 if least <= 100 else 1
    length = max(0, int(least * (n + m) / 200) - 1)
    while 200.0 * length / (n + m) < least:
        length += 1
    return length


def lengths(n: int, least: float) -> list[int]:
    """Lengths of texts that can reach ``least`` with one of n characters."""
    most = int(n * (200 / least - 1)) + 2
    return [m for m in range(most + 1) if common(n, m, least) <= min(n, m)]


@cache
def gram_size(n: int, m: int, least: float) -> tuple[int, int]:
    """(size, shared): the length of the grams by which texts of n and m characters are found, and how many they share at least. The longest of which they share one: longer grams are rarer by more than they are shared less. (0, 0) if there is none."""
    length = common(n, m, least)
    for size in (4, 3, 2):
        shared = length - (size - 1) * (n + m - 2 * length) - (size - 1)
        if shared > 0:
            return size, shared
    return 0, 0


def prefixes(n: int, least: float, there: Collection[int]) -> dict[int, tuple[int, list[int]]]:
    """For each gram size how many of the rarest grams of a text of n characters must be looked at, and the lengths of the partners that are found by them; size 0: those that needn't share any."""
    fit: dict[int, list[int]] = {}
    for m in lengths(n, least):
        if m in there:
            fit.setdefault(gram_size(n, m, least)[0], []).append(m)
    return {size: (n - size + 2 - min(gram_size(n, m, least)[1] for m in ms) if size else 0, ms) for size, ms in fit.items()}


def candidates(names: DataFrame, blocks: Sequence[str], least: float) -> DataFrame:
    """(a, b): each pair of names of a block that may reach ``least``, once, the smaller id first. ``names``: (id, text, blocks), texts with sorted tokens, ids unlike each other; null blocks are blocks.

    At 93 the grams leave a few candidates a name, at 85 some hundredths of all pairs; at 80 and below, where texts needn't share much, up to most pairs of fitting lengths are compared.
    """
    if least <= 0:
        raise ValueError("a similarity of 0 joins all pairs")
    spark = names.sparkSession
    names = names.withColumn("_n", F.length("text"))
    known = {r[0] for r in names.select("_n").distinct().collect()}  # as many rows as there are lengths
    bounds = [(n, size, look, fit) for n in known for size, (look, fit) in prefixes(n, least, known).items()]
    bounds = spark.createDataFrame(bounds or [(0, 0, 0, [0])], "_n int, _size int, _look int, _fit array<int>")
    key = F.struct(*(q(b) for b in blocks)) if blocks else F.lit(0)
    rows = names.select("id", "text", "_n", key.alias("_block"))
    each = rows.join(F.broadcast(bounds), "_n")

    grams = F.transform(F.sequence(F.lit(1), F.col("_n") - F.col("_size") + 1), lambda k: F.substring(F.col("text"), k, F.col("_size")))
    every = each.where("_size > 0").select("id", "_n", "_size", "_look", "_fit", "_block", F.explode(grams).alias("gram"))
    # The same gram again is another element: its number stands beside it.
    counted = every.groupBy("id", "_n", "_size", "_look", "_fit", "_block", "gram").agg(F.count("*").alias("_times"))
    often = counted.groupBy("gram").agg(F.count("*").alias("_often"))
    listed = counted.join(often, "gram").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    rarest = Window.partitionBy("id", "_size").orderBy("_often", "gram", "_time")
    held = listed.withColumn("_at", F.row_number().over(rarest)).where("_at <= _look").select("id", "_n", "_fit", "_block", "gram", "_time")
    a = held.select(F.col("id").alias("a"), F.col("_fit").alias("_fit1"), "_block", "gram", "_time")
    b = held.select(F.col("id").alias("b"), F.col("_n").alias("_n2"), "_block", "gram", "_time")
    fits = F.array_contains("_fit1", F.col("_n2"))
    by_gram = a.join(b, (a["_block"].eqNullSafe(b["_block"])) & (a["gram"] == b["gram"]) & (a["_time"] == b["_time"]) & (F.col("a") < F.col("b")) & fits).select("a", "b")
    sought = each.where("_size = 0").select(F.col("id").alias("a"), "_block", F.explode("_fit").alias("_n"))
    other = rows.select(F.col("id").alias("b"), "_block", "_n")
    by_length = sought.join(other, (sought["_block"].eqNullSafe(other["_block"])) & (sought["_n"] == other["_n"]) & (F.col("a") < F.col("b"))).select("a", "b")
    return by_gram.unionByName(by_length).distinct()


def pairs(names: DataFrame, blocks: Sequence[str], least: float) -> DataFrame:
    """(a, b, score): all pairs of names of a block whose token-sorted ratio is ``least`` or more, each once, the smaller id first. ``names``: (id, text, blocks) with texts as they are; a null text is an empty one."""
    texts = names.select("id", sorted_tokens(F.coalesce("text", F.lit(""))).alias("text"), *(q(b) for b in blocks))
    found = candidates(texts, blocks, least)
    left, right = (texts.select(F.col("id").alias(i), F.col("text").alias(f"_{i}")) for i in "ab")
    return found.join(left, "a").join(right, "b").withColumn("score", sorted_ratio("_a", "_b")).where(F.col("score") >= least).select("a", "b", "score")
