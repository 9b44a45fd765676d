"""Native word expressions: A-Z lower-cased, words of letters, digits and all characters beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """array<string>; a null text has no words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_A_WORD), "")


def places(n: Column) -> Column:
    """The positions 0 to n - 1, none where n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often and in whichever lambda they are read.

    The optimizer copies an expression into the place that reads it, also into a lambda that runs for every
    element of an array; it doesn't copy through a generator.
    """
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(made)))


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores after it as make it differ from all that are taken, whatever their case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], salts: int = 16) -> DataFrame:
    """``many`` joined with ``few``, which has one row a key. A key's rows are dealt to ``salts`` tasks by the columns ``by``; each of those has its row of ``few``."""
    salted = many.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(each, [*keys, "salt"]).drop("salt")
