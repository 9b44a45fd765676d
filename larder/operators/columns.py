"""Projection operators: pruning, renaming, coalescing, units, caps, imputation and a uniform schema."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import at_most, count_present, round_significant, sum_present


def q(name: str) -> Column:
    """A column by its literal name, whatever signs are in it."""
    return F.col(f"`{name}`")


def keep(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns that there are, in the allowed order."""
    return df.select(*(q(c) for c in allowed if c in df.columns))


def drop_like(df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    return df.select(*(q(c) for c in df.columns if c not in names and not c.startswith(tuple(prefixes) or ("\0",))))


def harmonise(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """One column a target name: the first non-null of the column itself and its aliases, in column order. Other columns stay."""
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        targets.setdefault(aliases.get(c, c), []).append(c)
    own_first = {t: sorted(cs, key=lambda c: c != t) for t, cs in targets.items()}
    return df.select(*((F.coalesce(*map(q, cs)) if len(cs) > 1 else q(cs[0])).alias(t) for t, cs in own_first.items()))


def prefer(df: DataFrame, priorities: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each target the first non-null of an ordered list of columns, of those that there are; the target itself counts only where listed."""
    made = {}
    for target, sources in priorities.items():
        there = [q(c) for c in sources if c in df.columns]
        if there:
            made[target] = F.coalesce(*there)
    return df.withColumns(made)


def unit_columns(df: DataFrame, macros: Sequence[str] = ("protein", "fat", "carbohydrate", "fiber", "sugar", "starch", "water")) -> DataFrame:
    """``<name>_MG_100G``, ``_KCAL_100G`` and ``_KJ_100G`` become ``<Name> (g)``, ``(mg)`` or ``(KCAL)``: macros in grams, kilojoules over 4.184. Values that a target has stay."""
    made: dict[str, Column] = {}
    gone = []
    for c in df.columns:
        m = re.fullmatch(r"(.+)_(MG|KCAL|KJ)_100G", c, re.IGNORECASE)
        if not m:
            continue
        name, unit = m[1].replace("_", " ").title(), m[2].upper()
        macro = any(w in name.lower() for w in macros)
        target, value = {"MG": (f"{name} (g)", q(c) / 1000) if macro else (f"{name} (mg)", q(c)), "KCAL": (f"{name} (KCAL)", q(c)), "KJ": (f"{name} (KCAL)", q(c) / 4.184)}[unit]
        made[target] = F.coalesce(made.get(target, q(target) if target in df.columns else F.lit(None).cast("double")), value)
        gone.append(c)
    return df.withColumns(made).drop(*gone)


def cap_impossible(df: DataFrame, kcal: float = 900, grams: float = 100, skip: Sequence[str] = ("Total Weight (g)",)) -> DataFrame:
    """Energy above 900 kcal and anything above 100 g in 100 g becomes null; pack weights aren't nutrients."""
    limits = {c: kcal if "(KCAL)" in c else grams for c in df.columns if c not in skip and ("(KCAL)" in c or "(g)" in c)}
    return df.withColumns({c: at_most(q(c), lim) for c, lim in limits.items()})


def impute_sums(df: DataFrame, sums: Mapping[str, Sequence[str]]) -> DataFrame:
    """A missing aggregate becomes the sum of the parts that there are."""
    made = {}
    for target, parts in sums.items():
        there = [q(p) for p in parts if p in df.columns]
        if there:
            own = [q(target)] if target in df.columns else []
            made[target] = F.coalesce(*own, sum_present(*there))
    return df.withColumns(made)


def uniform(df: DataFrame, text: Sequence[str], numbers: Sequence[str], digits: int | None = 3) -> DataFrame:
    """Exactly these columns: text ones first as strings, then numbers by name as doubles, unreadable or missing ones null, rounded to significant figures."""
    number = lambda c: q(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    shown = [(q(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in text]
    return df.select(*shown, *((round_significant(number(c), digits) if digits else number(c)).alias(c) for c in sorted(numbers)))


def completeness(df: DataFrame, nutrients: Sequence[str], to: str = "nutri_count") -> DataFrame:
    return df.withColumn(to, count_present(*map(q, nutrients)))


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """``right`` with the left's spelling of the columns that both have but for case; others are left out."""
    at = {c.lower(): c for c in right.columns}
    return right.select(*(q(at[c.lower()]).alias(c) for c in left.columns if c.lower() in at))


def flatten_nutrients(df: DataFrame, id_col: str, nested: str, names: Sequence[str] | None = None) -> DataFrame:
    """One row a food from an array of nutrients: ``nut_<name>_<unit>``, from the nested shape or else the flat one; of repeated ones the last counts.

    ``names``: the columns to make, if they are known, which saves a job.
    """
    each = df.select(id_col, F.posexplode_outer(nested).alias("at", "n"))
    name = F.coalesce("n.nutrient.name", "n.nutrientName")
    unit = F.coalesce("n.nutrient.unitName", "n.unitName")
    key = F.concat_ws("_", F.lit("nut"), F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_")), F.lower(unit))
    long = each.select(id_col, "at", F.when(name.isNotNull(), key).alias("key"), F.coalesce("n.amount", "n.value").alias("value"))
    last = long.groupBy(id_col, "key").agg(F.max_by("value", "at").alias("value"))
    wide = last.groupBy(id_col).pivot("key", list(names) if names is not None else None).agg(F.first("value", ignorenulls=True))
    return wide.drop("null")


# Parts of a column's name that make it a macronutrient's.
MACRO_KEYWORDS = ("calorie", "energy", "protein", "carbohydrate", "fiber", "sugar", "starch", "fat", "cholesterol", "alcohol", "omega", "ala", "epa", "dha")


def is_macro(name: str) -> bool:
    """Whether a column's name, whatever its case, tells of a macronutrient."""
    return any(k in name.lower() for k in MACRO_KEYWORDS)


def macro_columns(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """(macros, others) of nutrient columns, in their order."""
    return [n for n in names if is_macro(n)], [n for n in names if not is_macro(n)]
