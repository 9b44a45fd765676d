"""Ordered rules over names and values, as generated CASE expressions: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numbers import col
from .text import without_cooking


def any_of(words: Iterable[str]) -> str:
    """A pattern of the words, by their first characters, so that a place of a text is compared with few of them. Of those that stand at a place it finds the one listed first."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    return "|".join(rf"\Q{first}\E(?:" + "|".join(rf"\Q{rest}\E" for rest in rests) + ")" for first, rests in by_first.items())


def any_in(text: Column, words: Iterable[str]) -> Column:
    """True if the text holds any of the words; one regular expression, so one pass over the text."""
    return F.coalesce(text.rlike(any_of(words)), F.lit(False))


def first_rule(text: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The value of the first rule of which a word is in the text, in one pass over it; null if there is none."""
    words = [w for ws, _ in rules for w in ws]
    values = [value for ws, value in rules for _ in ws]
    # At each place the listed words' first, so the least of them is that of the whole text.
    found = F.regexp_extract_all(text, F.lit(f"(?=({any_of(words)}))"), 1)
    at = F.array_min(F.transform(found, lambda w: F.array_position(F.array(*map(F.lit, words)), w)))
    return F.try_element_at(F.array(*map(F.lit, values)), at.cast("int"))


def first_of(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for test, value in reversed(rules):
        out = F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def category_label(c: Column | str) -> Column:
    """single, category, composite or supplement from a category's name; null for none, blank, foreign or unknown ones."""
    text = F.lower(F.trim(col(c)))
    rules = [(F.coalesce(text, F.lit("")) == "", None), (text.contains(":"), None)]
    exact = [("supplement", fixed.SUPPLEMENT_CATEGORIES), ("composite", fixed.COMPOSITE_CATEGORIES), ("single", fixed.SINGLE_CATEGORIES), ("category", fixed.CATEGORY_CATEGORIES)]
    part = [("supplement", fixed.SUPPLEMENT_KEYWORDS), ("composite", fixed.COMPOSITE_KEYWORDS), ("single", fixed.SINGLE_KEYWORDS), ("category", fixed.CATEGORY_KEYWORDS)]
    rules += [(text.isin(words), F.lit(label)) for label, words in exact]
    rules += [(any_in(text, words), F.lit(label)) for label, words in part]
    return first_of([(t, F.lit(None).cast("string") if v is None else v) for t, v in rules], F.lit(None).cast("string"))


def name_label(c: Column | str) -> Column:
    """A label from a product's name: unknown for a blank one, category where nothing else is found."""
    text = F.lower(F.trim(col(c)))
    dish = any_in(text, fixed.COMPOSITE_NAMES) & ~any_in(text, fixed.FALSE_COMPOSITE_NAMES)
    single = any_in(text, fixed.SINGLE_NAMES) & ~any_in(text, fixed.NOT_SINGLE_NAMES)
    return first_of([(F.coalesce(text, F.lit("")) == "", "unknown"), (any_in(text, fixed.SUPPLEMENT_KEYWORDS), "supplement"), (dish, "composite"), (single, "single")], "category")


def label(category: Column | str, name: Column | str) -> Column:
    return F.coalesce(category_label(category), name_label(name))


UNKNOWN = "unknown | unknown | unknown"


def keyword_descriptor(c: Column | str) -> Column:
    """The descriptor of the first rule of which a word is in the name without its preparation, else in the whole name."""
    found = [first_rule(F.lower(text), fixed.KEYWORD_DESCRIPTORS) for text in (without_cooking(c), col(c))]
    return F.coalesce(*found, F.lit(UNKNOWN))


def mapped(c: Column | str, table: dict[str, str], otherwise: str = UNKNOWN) -> Column:
    """A table's value for a column, without a join."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, col(c)), F.lit(otherwise))


def meat_kind(c: Column | str) -> Column:
    """processed, red or null; processed goes first."""
    text = F.lower(col(c))
    return F.when(any_in(text, fixed.PROCESSED_MEAT), "processed").when(any_in(text, fixed.RED_MEAT), "red")


def spice_kind(c: Column | str) -> Column:
    text = F.lower(col(c))
    return F.when(any_in(text, fixed.DRIED_SPICE), "spice").when(any_in(text, fixed.FRESH_HERB), "herb")


def is_seasoning(c: Column | str) -> Column:
    return any_in(F.lower(col(c)), [*fixed.DRIED_SPICE, *fixed.FRESH_HERB, *fixed.SAUCE])


def excluded(c: Column | str, patterns: Sequence[str] = fixed.EXCLUDED_NAMES, also: Sequence[str] = (), whole_words: bool = False) -> Column:
    """True if any pattern is found in the lower-cased name, or any of the user's words is part of it. ``whole_words``: patterns match whole words only."""
    text = F.lower(col(c))
    hit = text.rlike("|".join(rf"\b(?:{p})\b" if whole_words else f"(?:{p})" for p in patterns))
    return F.coalesce(hit, F.lit(False)) | (any_in(text, [w.lower() for w in also]) if also else F.lit(False))


def confidence(similarity: Column | str, deviation: Column | str) -> Column:
    """HIGH, MEDIUM or LOW from a similarity and a deviation, which may be null."""
    s, d = col(similarity), col(deviation)
    return (
        F.when((s >= 0.85) & (d.isNull() | (d <= 0.30)), "HIGH").when((s >= 0.85) & (d <= 0.50), "MEDIUM")
        .when((s >= 0.70) & (d <= 0.20), "HIGH").when((s >= 0.70) & (d.isNull() | (d <= 0.35)), "MEDIUM")
        .when((s >= 0.55) & (d <= 0.15), "MEDIUM").otherwise("LOW")
    )


def compliance(actual: Column | str, low: Column | str, high: Column | str, slack: float = 0.20) -> tuple[Column, Column]:
    """(status, error percent): slack decides the status, the error is measured from the bound itself. Null or zero bounds don't bind."""
    a, lo, hi = col(actual), F.nullif(col(low), F.lit(0.0)), F.nullif(col(high), F.lit(0.0))
    under, over = a < lo * (1 - slack), a > hi * (1 + slack)
    status = F.when(under, "below_min").when(over, "above_max").otherwise("in_range")
    error = F.when(under, (lo - a) / lo * 100).when(over, (a - hi) / hi * 100)
    return status, F.round(error, 1)


def calorie_compliance(actual: Column | str, target: Column | str, slack: float = 0.05) -> tuple[Column, Column]:
    a, t = col(actual), col(target)
    return compliance(a, t * (1 - slack), t * (1 + slack), 0.0)


def bound_status(actual: Column | str, low: Column | str, high: Column | str, slack: float = 0.1) -> Column:
    a = col(actual)
    return F.when(a < col(low) - slack, "LOW").when(a > col(high) + slack, "HIGH").otherwise("OK")


def pack_sizes(name: Column | str, category: Column | str, table: dict[str, list[int]] = fixed.PACK_SIZES, otherwise: Sequence[int] = (400,)) -> Column:
    """Usual pack sizes of the first word of the table that the name and category hold."""
    text = F.lower(F.concat_ws(" ", F.coalesce(col(name), F.lit("")), F.coalesce(col(category), F.lit(""))))
    sizes = lambda v: F.array(*(F.lit(int(x)) for x in v))
    return first_of([(any_in(text, [k]), sizes(v)) for k, v in table.items()], sizes(otherwise))


# Groups of foods that users may leave out or let in, with their default.
TOGGLES = {
    "liver": (["liver"], True),
    "yeast_extract": (["yeast extract", "marmite", "vegemite"], True),
    "fortified_drinks": (["instant breakfast", "drink mix, powder", "meal replacement"], True),
    "dried_herbs": (["dried", "freeze-dried"], False),
    "fish_oil": (["fish oil", "cod liver oil"], False),
}


def toggled(c: Column | str, chosen: dict[str, bool] | None = None) -> Column:
    """True if a food is in a group that is left out, by the user's choice or else the default."""
    out = F.lit(False)
    for name, (words, default) in TOGGLES.items():
        if (chosen or {}).get(name, default):
            out = out | any_in(F.lower(col(c)), words)
    return out
