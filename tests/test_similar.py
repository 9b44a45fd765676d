import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.functions.similarity import token_sort_ratio
from larder.operators import similar

WORDS = ["cheddar", "chedder", "milk", "mild", "mature", "tesco", "tescos", "semi", "skimmed", "skim", "a", "of", "the", "organic", "organics", "fish"]


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        name = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 5)))
        if name and rng.random() < 0.4:
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice(["", "x", " ", "é"]) + name[k + 1 :]
        out.append(name)
    return [*out, "", "  ", "a", "ab", "ba", "\x1cmilk\xa0tesco", "x" * 600, "x" * 590 + "y" * 10]


@pytest.mark.parametrize("least", [100, 93, 90, 85, 80, 60, 30])
def test_pairs_are_all_of_them(spark, least):
    names = sorted(set(made(160, least)))
    rows = [(k, n, [None, "b"][k % 7 == 0]) for k, n in enumerate(names)] + [(1000, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, block string")
    got = {(r.a, r.b): r.score for r in similar.pairs(df, ["block"], least).collect()}
    want = {}
    for i, (a, x, u) in enumerate(rows):
        for b, y, v in rows[i + 1 :]:
            if u == v and (score := token_sort_ratio(x or "", y or "")) >= least:
                want[a, b] = score
    assert got == want and want


def test_bounds():
    """No pair that reaches the threshold has lengths or common grams below what the index relies on."""
    rng = random.Random(3)
    near = 0
    for _ in range(6000):
        x = "".join(rng.choice("ab cde") for _ in range(rng.randint(0, 24)))
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        x, y = (" ".join(sorted(s.split())) for s in (x, "".join(y)))
        for least in (60, 80, 85, 93):
            if token_sort_ratio(x, y) >= least:
                assert len(y) in similar.lengths(len(x), least)
                size, shared = similar.gram_size(len(x), len(y), least)
                assert (size, shared) == similar.gram_size(len(y), len(x), least)
                count = lambda s: Counter(s[k : k + size] for k in range(len(s) - size + 1))  # noqa: E731, B023
                assert not size or (count(x) & count(y)).total() >= shared
                near += size > 0
    assert near > 2000


def test_a_large_block_has_few_candidates(spark):
    """50,000 names of one block: a few candidates a name, not 10^9 pairs."""
    n = 50_000
    letter = lambda k, i: F.char(97 + F.pmod(F.xxhash64((F.col("id") * (k + 7)) % (3000 + 500 * k), F.lit(k), F.lit(i)), F.lit(26)))
    word = lambda k: F.concat(*(letter(k, i) for i in range(4 + k)))
    names = spark.range(n).select("id", F.concat_ws(" ", *(word(k) for k in range(5)), F.when(F.col("id") % 5 == 0, "x")).alias("text"))
    texts = names.select("id", similar.sorted_tokens(F.col("text")).alias("text"), F.lit("all").alias("block"))
    assert similar.candidates(texts, ["block"], 93).count() < 60 * n
