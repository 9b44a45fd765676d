"""Grouped aggregations over foods, products and plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import q


def squash(c: Column | str, split: str | None = None, without: Sequence[str] = ("unknown",)) -> Column:
    """Aggregate: the distinct trimmed non-empty values in order, joined. ``split`` cuts each value first."""
    c = q(c) if isinstance(c, str) else c
    values = F.collect_set(c)
    if split:
        values = F.flatten(F.transform(values, lambda x: F.split(x, split)))
    fine = F.filter(F.transform(values, F.trim), lambda x: (x != "") & ~F.lower(x).isin(list(without)))
    return F.array_join(F.array_sort(F.array_distinct(fine)), " | ")


def spread(nutrients: Sequence[str]) -> list[Column]:
    """Aggregates: mean of each nutrient, and its least and largest value where they differ."""
    out = []
    for n in nutrients:
        low, high = F.min(q(n)), F.max(q(n))
        out += [F.avg(q(n)).alias(n), F.when(low < high, low).alias(f"{n}_min"), F.when(low < high, high).alias(f"{n}_max")]
    return out


def archetypes(df: DataFrame, keys: Sequence[str], nutrients: Sequence[str], squashed: Sequence[str] = (), first: Mapping[str, str] | None = None) -> DataFrame:
    """One row a key (null keys are keys): nutrient means and spreads, squashed texts, and of some columns the value at the least of another."""
    firsts = [F.min_by(q(c), q(by)).alias(c) for c, by in (first or {}).items()]
    return df.groupBy(*map(q, keys)).agg(*spread(nutrients), *(squash(c).alias(c) for c in squashed), *firsts, F.count("*").alias("n"))


def pivot_mean(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(q(key)).pivot(name, list(names)).agg(F.avg(q(value)))


def pivot_first(df: DataFrame, key: str, name: str, value: str, order: str, names: Sequence[str]) -> DataFrame:
    """Wide rows of the value that comes first in ``order``."""
    return df.where(q(value).isNotNull()).groupBy(q(key)).pivot(name, list(names)).agg(F.min_by(q(value), q(order)))


def base_score(name: Column | str) -> Column:
    """How well a name fits to stand for its group: raw and dry ones do, long and cooked ones don't."""
    text = F.lower(q(name) if isinstance(name, str) else name)
    raw = F.when(text.contains("raw"), 15.0).otherwise(0.0)
    dry = F.when(text.contains(" dry") | text.contains("dried"), 10.0).otherwise(0.0)
    cooked = F.when(text.rlike("fried|cooked|boiled|roasted|canned"), 20.0).otherwise(0.0)
    return raw + dry - cooked - 0.05 * F.length(text)


def base_rows(df: DataFrame, group: str, name: str, id_col: str, macros: Sequence[str], micros: Sequence[str], cooked: str = "fried|roasted|boiled|cooked|steamed|poached|microwaved|baked|canned|grilled|stewed|braised|toasted|simmered|barbecued") -> DataFrame:
    """One row a group: macros of its base row, micros' means and spreads over the rows that count.

    The base row has the largest ``base_score``, then the smallest id. Cooked variants don't count unless the base itself is cooked or no others are left. ``discrepancy``: some micro's values differ by more than 10 %.
    """
    scored = df.withColumns({"_score": base_score(name), "_cooked": F.lower(q(name)).rlike(cooked)})
    order = F.struct(F.col("_score"), -q(id_col).cast("long"))
    base = scored.groupBy(q(group)).agg(F.max_by(F.struct(q(id_col).alias("id"), q(name).alias("name"), F.col("_cooked").alias("cooked"), *(q(m).alias(m) for m in macros)), order).alias("_base"), F.bool_and("_cooked").alias("_all"))
    joined = scored.join(base, group).where(~F.col("_cooked") | F.col("_base.cooked") | F.col("_all"))
    gaps = [F.coalesce((F.max(q(m)) - F.min(q(m))) / F.max(q(m)) > 0.10, F.lit(False)) for m in micros]
    anyone = gaps[0]
    for g in gaps[1:]:
        anyone = anyone | g
    head = [F.first("_base.id").alias("base_id"), F.first("_base.name").alias("base_name"), *(F.first(f"_base.{m}").alias(m) for m in macros)]
    return joined.groupBy(q(group)).agg(*head, *spread(micros), anyone.alias("discrepancy"), F.count("*").alias("n"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share): non-null values of each column, in one pass."""
    shares = df.agg(*(F.avg(q(c).isNotNull().cast("double")).alias(c) for c in columns))
    return shares.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), q(c).alias("share")) for c in columns))))


def word_counts(df: DataFrame, words: Column, most: int = 300) -> DataFrame:
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def shares(df: DataFrame, by: str) -> DataFrame:
    """(value, n, percent)"""
    counts = df.groupBy(q(by).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def name_variations(names: Column, least: int = 4) -> Column:
    """One text for an array of names: their common prefix, up to its last comma or else space, and the distinct rests in brackets ("base" for none).

    All names in order, joined, if the prefix is shorter than ``least``; a single name stays.
    """
    each = F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))
    first, last = F.get(each, F.lit(0)), F.get(each, F.size(each) - 1)
    # The common prefix of sorted texts is that of the first and the last.
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(first), F.length(last)), F.lit(1)))
    same = F.aggregate(places, F.lit(0), lambda acc, k: F.when((acc == k - 1) & (F.substr(first, F.lit(1), k) == F.substr(last, F.lit(1), k)), k).otherwise(acc))
    prefix = F.substr(first, F.lit(1), same)
    upto = lambda sign: F.nullif(F.length(F.regexp_extract(prefix, f"^(.*{sign})", 1)), F.lit(0))
    cut = F.coalesce(upto(","), upto(" "), same)
    bare = lambda x: F.btrim(x, F.lit(" ,"))
    rests = F.transform(F.array_sort(F.array_distinct(F.transform(each, lambda n: bare(F.substr(n, cut + 1))))), lambda r: F.when(r == "", "base").otherwise(r))
    listed = F.concat(bare(F.substr(first, F.lit(1), cut)), F.lit(" ["), F.array_join(rests, ", "), F.lit("]"))
    return F.when(F.size(each) <= 1, F.coalesce(first, F.lit(""))).when(cut < least, F.array_join(each, " | ")).otherwise(listed)


def merge_groups(df: DataFrame, cluster: str, id_col: str, members: str, brands: str, kept: Sequence[str]) -> DataFrame:
    """One row a cluster of product groups: ``kept`` columns of the group with most members, then most brands, then the smallest id; brands united, ids listed, members summed. ``brands`` is an array."""
    order = F.struct(q(members), F.size(brands), -q(id_col))
    head = F.max_by(F.struct(q(id_col).alias("canonical_id"), *(q(c).alias(c) for c in kept)), order)
    out = df.groupBy(q(cluster).alias("group_id")).agg(head.alias("_h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(brands)))).alias("brands"), F.array_sort(F.collect_list(q(id_col))).alias("food_ids"), F.sum(members).alias("members"))
    return out.select("group_id", "_h.*", "brands", "food_ids", "members")


def group_members(groups: DataFrame) -> DataFrame:
    """(food_id, group_id) from groups with an array of ids."""
    return groups.select(F.explode("food_ids").alias("food_id"), "group_id")


def source_quality(df: DataFrame, keys: Sequence[str], source: str, nutrients: Sequence[str], share: float = 0.10) -> DataFrame:
    """Means and spreads of each key, the number of its sources, and whether some nutrient's values differ by more than ``share``."""
    differ = F.lit(False)
    for n in nutrients:
        differ = differ | F.coalesce((F.max(q(n)) - F.min(q(n))) / F.nullif(F.max(q(n)), F.lit(0.0)) > share, F.lit(False))
    return df.groupBy(*map(q, keys)).agg(*spread(nutrients), F.count_distinct(q(source)).alias("source_count"), differ.alias("discrepancy"))


def amount_of(nutrients: Column | str, name: Column | str) -> Column:
    """A map's value for a nutrient: by its exact name, else the first key that is equal but for case, else the first that holds the name; else 0."""
    nutrients, name = (F.col(c) if isinstance(c, str) else c for c in (nutrients, name))
    first = lambda test: F.get(F.filter(F.map_entries(nutrients), test), F.lit(0))["value"]
    low = F.lower(name)
    return F.coalesce(F.try_element_at(nutrients, name), first(lambda e: F.lower(e["key"]) == low), first(lambda e: F.lower(e["key"]).contains(low)), F.lit(0.0))
