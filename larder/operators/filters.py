"""Row filters and the splits that keep what they reject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.classify import excluded
from ..functions.numbers import count_present, sum_present
from .columns import q


def complete(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(needed))


def holds(c: Column | str, part: str) -> Column:
    """Case-blind part of a text; false for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))


def good_quality(df: DataFrame, required: Sequence[str], extra: Sequence[str], name: str, completeness: str, above: float = 0.5, least_extra: int = 3) -> DataFrame:
    """Complete enough, with all required values, none negative, some of the extra ones, and a name."""
    ok = F.col(completeness) > above
    for c in required:
        ok = ok & (q(c) >= 0)
    return df.where(ok & (count_present(*map(q, extra)) >= least_extra) & (F.trim(q(name)) != ""))


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df`` and what its next action will have counted: the rows for which each condition holds, without a pass of their own. ``seen.get`` waits for that action; filters above aren't pushed below the count."""
    seen = Observation()
    return df.observe(seen, *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items())), seen


def wanted(df: DataFrame, name: str, patterns: Sequence[str] = fixed.EXCLUDED_NAMES, also: Sequence[str] = (), whole_words: bool = False) -> tuple[DataFrame, Observation]:
    """The rows whose names aren't excluded, and how many were ``kept`` and ``excluded``, known after an action on the rows."""
    marked = df.withColumn("_out", excluded(q(name), patterns, also, whole_words))
    watched, seen = counted(marked, kept=~F.col("_out"), excluded=F.col("_out"))
    return watched.where("not _out").drop("_out"), seen


def mark_physics(df: DataFrame, protein: str, fat: str, carbs: str, limit: float = 105, atwater: tuple[str, float] | None = None) -> DataFrame:
    """``df`` with ``flag_reason``, empty for clean rows: flagged where the macros weigh more than ``limit`` grams in 100.

    ``atwater``: an energy column and a tolerance, to flag energies that don't follow from the macros as well.
    """
    total = sum_present(q(protein), q(fat), q(carbs))
    reasons = [F.when(total > limit, F.format_string("MACRO_SUM(P+F+C)=%.1fg>%sg; ", total, F.lit(f"{limit:g}")))]
    if atwater:
        energy, slack = atwater
        want = q(protein) * 4 + q(carbs) * 4 + q(fat) * 9
        reasons.append(F.when(F.abs(q(energy) - want) > slack * want, "ATWATER; "))
    return df.withColumn("flag_reason", F.concat(*(F.coalesce(r, F.lit("")) for r in reasons)))


def physics(df: DataFrame, protein: str, fat: str, carbs: str, limit: float = 105, atwater: tuple[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, flagged with ``flag_reason``) of ``mark_physics``; each reads the source. ``write_physics`` writes both in one pass."""
    marked = mark_physics(df, protein, fat, carbs, limit, atwater)
    return marked.where("flag_reason = ''").drop("flag_reason"), marked.where("flag_reason <> ''")


def write_physics(df: DataFrame, path: str, protein: str, fat: str, carbs: str, limit: float = 105, atwater: tuple[str, float] | None = None) -> dict[str, int]:
    """Writes ``path/flagged=false`` and ``path/flagged=true`` in one pass over the source and returns the numbers of rows ``clean`` and ``flagged``, counted in it."""
    flagged = F.col("flag_reason") != ""
    marked, seen = counted(mark_physics(df, protein, fat, carbs, limit, atwater), clean=~flagged, flagged=flagged)
    marked.withColumn("flagged", flagged).write.partitionBy("flagged").parquet(path)
    return dict(seen.get)


def any_value(df: DataFrame, nutrients: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(*(q(c).cast("string") for c in nutrients)).isNotNull())


def without_categories(df: DataFrame, category: str, names: Sequence[str]) -> DataFrame:
    """Rows whose category isn't listed, case-blind; rows without one stay."""
    return df.where(~F.coalesce(F.lower(q(category)).isin([n.lower() for n in names]), F.lit(False)))


def plausible(df: DataFrame, grams: Sequence[str], kcal: str) -> DataFrame:
    """Impossible reference values become null; ``has_macros`` tells whether all are left."""
    made = {c: F.when(q(c) <= 100, q(c)) for c in grams} | {kcal: F.when(q(kcal) <= 900, q(kcal))}
    out = df.withColumns(made)
    return out.withColumn("has_macros", count_present(*map(q, made)) == len(made))


def attribute(df: DataFrame, id_col: str, name: str, patterns: Sequence[str], examples: int = 3) -> DataFrame:
    """(pattern, n, examples): each row counts for the first pattern that its lower-cased name matches; examples are the first names."""
    text = F.lower(q(name))
    which = F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in enumerate(patterns)))
    hit = df.select(q(id_col).alias("id"), q(name).alias("name"), which.alias("k")).where("k is not null")
    first = Window.partitionBy("k").orderBy("id")
    shown = hit.withColumn("r", F.row_number().over(first)).where(F.col("r") <= examples)
    shown = shown.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), " | ").alias("examples"))
    labels = F.element_at(F.array(*map(F.lit, patterns)), F.col("k") + 1)
    return hit.groupBy("k").agg(F.count("*").alias("n")).join(shown, "k").select(labels.alias("pattern"), "n", "examples")
