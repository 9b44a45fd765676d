"""Numeric column expressions: rounding, capping, null-skipping sums and deviations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: Column | str, digits: int = 2) -> Column:
    """Half-even rounding of the binary product, as array libraries round."""
    return F.rint(col(c) * F.lit(10.0**digits)) / F.lit(10.0**digits)


def round_significant(c: Column | str, n: int = 3) -> Column:
    """``n`` significant figures; zero and null stay."""
    c = col(c)
    power = F.pow(F.lit(10.0), F.lit(float(n - 1)) - F.floor(F.log10(F.abs(c))).cast("double"))
    return F.when(c == 0, c).otherwise(F.rint(c * power) / power)


def at_most(c: Column | str, limit: float) -> Column:
    """Null where the value is impossible, above ``limit``."""
    c = col(c)
    return F.when(c <= limit, c)


def sum_present(*cs: Column | str) -> Column:
    """Sum that skips nulls; null if all are."""
    cs = tuple(map(col, cs))
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cs))
    return F.when(F.coalesce(*cs).isNotNull(), total)


def count_present(*cs: Column | str) -> Column:
    return reduce(lambda a, b: a + b, (col(c).isNotNull().cast("int") for c in cs))


def relative_gap(a: Column | str, b: Column | str) -> Column:
    """|a - b| over the larger absolute value."""
    a, b = col(a), col(b)
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


#: Fixed value: what a product may have of something of which its canonical food has nothing.
SLACK = 5.0


def deviation_from(product: list[Column | str], canonical: list[Column | str], slack: float = SLACK) -> Column:
    """Largest relative deviation from the canonical values. A canonical zero is skipped if the product has no more than ``slack``, else the deviation is infinite."""
    parts = []
    for p, c in zip(map(col, product), map(col, canonical), strict=True):
        zero = F.when(p > slack, F.lit(float("inf")))
        parts.append(F.when(c == 0, zero).otherwise(F.abs(p - c) / c))
    return F.coalesce(F.greatest(*parts) if len(parts) > 1 else parts[0], F.lit(0.0))


def deviation_between(left: list[Column | str], right: list[Column | str]) -> Column:
    """Largest deviation over the values that both have: relative to the larger, or absolute where the larger is below 1; null if none."""
    parts = []
    for a, b in zip(map(col, left), map(col, right), strict=True):
        top = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
        parts.append(F.when(top < 1, F.abs(a - b)).when(top.isNotNull(), F.abs(a - b) / top))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def within(left: list[Column | str], right: list[Column | str], floors: list[float], share: float = 0.15) -> Column:
    """True if all values that both have are within the larger of a floor and a share of the larger one."""
    tests = []
    for a, b, floor in zip(map(col, left), map(col, right), floors, strict=True):
        tests.append(F.coalesce(F.abs(a - b) <= F.greatest(F.lit(float(floor)), F.lit(share) * F.greatest(a, b)), F.lit(True)))
    return reduce(lambda x, y: x & y, tests)


def floor_for(name: str) -> float:
    """Absolute tolerance by a nutrient's unit."""
    low = name.lower()
    if "(kcal)" in low or "(kj)" in low:
        return 15.0
    if "(mg" in low:
        return 15.0
    if "(ug" in low or "(mcg" in low:
        return 5.0
    return 1.5


def near_first(first: list[Column | str], other: list[Column | str], floors: list[float], share: float = 0.15) -> Column:
    """True if all values are within the larger of a floor and a share of the first row's value; missing values count as 0."""
    tests = []
    for a, b, floor in zip(map(col, first), map(col, other), floors, strict=True):
        a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
        tests.append(F.abs(a - b) <= F.greatest(F.lit(float(floor)), share * a))
    return reduce(lambda x, y: x & y, tests)
