"""Benchmark decontamination by winnowing, in DataFrame operations only.

A k-gram of a text is a fingerprint where its hash is the least in some window of w consecutive k-grams.
Texts that share k + w - 1 words share a window and so its least k-gram: joining the fingerprints of documents with those of
the benchmark finds every shared span of that length. A hit is extended word by word both ways, as far as
a window around it can reach, and counts if the shared span holds a whole window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import column, fixed, free, places, words


def _marks(hashes: Column, n: Column, k: int, w: int) -> Column:
    """k-gram hashes of an array of word hashes."""
    return F.transform(places(n - k + 1), lambda i: F.xxhash64(*(F.get(hashes, i + x) for x in range(k))))


def _picked(df: DataFrame, k: int, w: int) -> DataFrame:
    """Adds ``picked``: array<struct<k, h, at, left, near>> of the fingerprints; near: hashes of the words about it, from at - left."""
    reach = w - 1
    df = fixed(df, grams=_marks(F.col("codes"), F.col("n"), k, w))
    chosen = places(F.col("n") - k + 1)
    if w > 1:
        least = lambda i: F.least(*(F.get("grams", i + x) for x in range(w)))
        df = fixed(df, lows=F.transform(places(F.col("n") - (k + w - 2)), least))
        # Windows that hold gram j start at j - w + 1 to j; it is the least of one of them if it is as large as their largest minimum.
        top = lambda j: F.greatest(*(F.get("lows", j - x) for x in range(w)))
        chosen = F.filter(chosen, lambda j: F.get("grams", j) == top(j))
    df = fixed(df, chosen=chosen)

    def about(j: Column) -> Column:
        left = F.least(j, F.lit(reach))
        near = F.slice("codes", j - left + 1, left + k + reach)
        return F.struct(F.lit(k).alias("k"), F.get("grams", j).alias("h"), j.alias("at"), left.alias("left"), near.alias("near"))

    return df.select("*", F.transform("chosen", about).alias("picked")).drop("grams", "lows", "chosen")


def _coded(df: DataFrame, text_col: str) -> DataFrame:
    df = fixed(df, codes=F.transform(words(F.col(text_col)), lambda x: F.xxhash64(x)))
    return df.withColumn("n", F.size("codes"))


def _same(step: int, reach: int, start: Column, other: Column) -> Column:
    """How many words agree going outwards from start in near and from other in item_near, at most reach."""
    agree = lambda t: F.coalesce(F.get("near", start + step * t) == F.get("item_near", other + step * t), F.lit(False))
    return reduce(lambda rest, t: F.when(agree(t), rest).otherwise(F.lit(t)), reversed(range(reach)), F.lit(reach))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 13, gram: int = 5, share: int = 20, broadcast_rows: int = 200_000,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated): one row a row of ``docs``.

    A document word is hit inside any occurrence of ``window`` consecutive words of an item, or of all words of a shorter item.
    ``contaminated``: some word is hit and ``share`` * n_hit >= n_words. Null and wordless texts have no words and no hits;
    wordless items have no windows; an item without an id is listed as an empty string. Rows equal in id and text get equal results; rows of one id with other texts are told apart; null ids
    are kept. The items' fingerprints are broadcast only where a count finds ``broadcast_rows`` or fewer, else joined by shuffle.
    """
    item = _coded(items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("_t")), "_t").where("n > 0").drop("_t")
    # A shorter item is one window: its only gram is all its words.
    shorts = sorted(x.n for x in item.where(F.col("n") < window).select("n").distinct().collect())
    shapes = [(gram, window - gram + 1), *((n, 1) for n in shorts)]
    marked = [_picked(item.where(F.col("n") >= window if w > 1 else F.col("n") == k), k, w) for k, w in shapes]
    keys = reduce(DataFrame.unionAll, (x.select("item", F.lit(w).alias("w"), F.inline("picked")) for x, (_, w) in zip(marked, shapes, strict=True)))
    keys = keys.select("k", "h", "item", (F.col("k") + F.col("w") - 1).alias("need"), F.col("left").alias("item_left"), F.col("near").alias("item_near"))
    keys = stage(keys.distinct(), "item-fingerprints")
    if keys.count() <= broadcast_rows:
        keys = F.broadcast(keys)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_t"))
    rows = _coded(rows, "_t").drop("_t")
    for m, (k, w) in enumerate(shapes):
        rows = _picked(rows, k, w).withColumnRenamed("picked", f"picked{m}")
    # Each row also sends itself, without a fingerprint, so one pass gives words and hits.
    own = F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("h"), F.lit(0).alias("at"), F.lit(0).alias("left"), F.lit(None).cast("array<bigint>").alias("near")))
    sent = rows.select("id", "text_hash", "n", F.inline(F.concat(own, *(f"picked{m}" for m in range(len(shapes))))))
    met = sent.join(keys, ["k", "h"], "left").where("k = 0 or item is not null")
    reach = window - gram
    before = _same(-1, reach, F.col("left") - 1, F.col("item_left") - 1)
    after = _same(1, reach, F.col("left") + F.col("k"), F.col("item_left") + F.col("k"))
    equal = reduce(lambda a, b: a & b, (F.get("near", F.col("left") + t).eqNullSafe(F.get("item_near", F.col("item_left") + t)) | (F.col("k") <= t) for t in range(max(k for k, _ in shapes))))
    met = met.select("id", "text_hash", "n", "k", "at", "item", "need", equal.alias("equal"), before.alias("before"), after.alias("after"))
    met = met.where("k = 0 or (equal and before + k + after >= need)")
    hit = F.when(F.col("k") > 0, F.struct((F.col("at") - F.col("before")).alias("a"), (F.col("at") + F.col("k") + F.col("after")).alias("b")))
    found = met.groupBy("id", "text_hash").agg(
        F.max("n").cast("long").alias("n_words"), F.count_if(F.col("k") == 0).alias("copies"),
        F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"))

    found = found.select("id", "n_words", F.aggregate("hits", start, cover)["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay, whatever their names, and rows of one id with other texts are judged apart.

    Null and wordless texts stay; rows that are equal in id and text stay or go together; an empty table gives no rows, and without items all rows stay.
    """
    key, bad = free("key", docs.columns), free("bad", docs.columns)
    keyed = docs.withColumn(key, F.struct(column(id_col).alias("i"), F.xxhash64(column(text_col)).alias("x")))
    judged = contamination(keyed.select(column(key).alias("_key"), column(text_col).alias("_text")), items, "_key", "_text", **how)
    dirty = judged.where("contaminated").select(F.col("_key").alias(bad)).distinct()
    return keyed.join(dirty.hint("shuffle_hash"), column(key).eqNullSafe(column(bad)), "left_anti").drop(key)
