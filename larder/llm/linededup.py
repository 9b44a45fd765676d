"""Line deduplication by winnowing over line hashes.

A line is a fingerprint where its hash is the least of some window of ``run`` consecutive lines. Two texts that share
``run`` lines in a row share the window's least line, so only windows whose fingerprint occurs more than once can repeat; the others are
left out before anything is compared. A fingerprint's occurrences are extended both ways to the windows that hold it. Each such window is joined
with its first occurrence, and where it isn't the first itself, its lines are deleted: what goes is the union of all windows that
occurred before, which is every maximal later run of ``run`` lines or more. With ``alone``, a line of so many words is a window by itself too,
so it goes wherever it occurred before, whatever stands beside it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import column, fixed, free, places, spread_join


def _windows(df: DataFrame, id_col: str, text_col: str, run: int, alone: int | None) -> DataFrame:
    """(id, text_hash, at, size, mark, mark_at, w1, w2): windows of ``run`` lines, and of one line of ``alone`` words or more, with the least line hash and its place."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_t"))
    rows = fixed(rows, lines=F.split(F.col("_t"), "\n")).drop("_t")
    rows = fixed(rows if alone else rows.where(F.size("lines") >= run), codes=F.transform("lines", lambda x: F.xxhash64(x)))

    def window(i: Column, size: int) -> Column:
        lines, codes = ([F.get(c, i + k) for k in range(size)] for c in ("lines", "codes"))
        marks = [F.struct(c.alias("h"), (i + k).alias("at")) for k, c in enumerate(codes)]
        least = F.least(*marks) if size > 1 else marks[0]
        # 128 bits of two differently built hashes stand for the window's text.
        w1, w2 = F.xxhash64(*lines), F.xxhash64(F.lit(7), *reversed(lines))
        return F.struct(i.alias("at"), *([F.lit(size).alias("size")] if alone else []), least["h"].alias("mark"), least["at"].alias("mark_at"), w1.alias("w1"), w2.alias("w2"))

    every = F.transform(places(F.size("lines") - (run - 1)), lambda i: window(i, run))
    if alone:
        long = F.filter(places(F.size("lines")), lambda i: _is_long(F.get("lines", i), alone))
        every = F.concat(every, F.transform(long, lambda i: window(i, 1)))
    return rows.select("id", "text_hash", F.inline(every))


def _is_long(line: Column, words: int) -> Column:
    """Whether white space parts a line into ``words`` or more; short lines aren't parted at all."""
    return F.when(F.length(line) < 2 * words - 1, False).otherwise(F.size(F.regexp_extract_all(line, F.lit(r"[^ \t\n\x0B\f\r]+"), 0)) >= words)


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, alone: int | None = None) -> DataFrame:
    """(id, text_hash, starts, foreign [, ones, foreign_ones]): for every text with later repeats, the sorted starts of the windows of ``run`` lines that occurred before, and of those that first did in another text; with ``alone`` the same for lines of so many words."""
    # Texts are parted once; all that follows reads the staged windows.
    windows = stage(_windows(df, id_col, text_col, run, alone), "windows")
    same = ["w1", "w2"] + ["size"] * bool(alone)
    place = lambda at: F.struct(F.col("id").isNull().alias("n"), "id", "text_hash", F.col(at).alias("at"))
    ends = lambda at: (F.min(place(at)).alias("first"), F.max(place(at)).alias("last"))
    # Fingerprints that are in more than one place; one row each, whatever the number of places.
    marks = windows.groupBy("mark").agg(*ends("mark_at")).where("first <> last").select("mark")
    # One very common line, or window, is the key of many rows; both joins deal them to several tasks.
    held = spread_join(windows, marks, ["mark"], ["id", "text_hash", "at"])
    # The windows about a fingerprint are its extensions both ways; a first place for each text of a window.
    again = held.groupBy(*same).agg(*ends("at")).where("first <> last").select(*same, "first")
    later = spread_join(held, again, same, ["id", "text_hash", "at"]).where(place("at") != F.col("first"))
    other = ~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_hash") == F.col("text_hash")))
    found = lambda *where: F.array_sort(F.collect_set(F.when(reduce(and_, where), F.col("at")) if where else F.col("at")))
    if not alone:
        return later.groupBy("id", "text_hash").agg(found().alias("starts"), found(other).alias("foreign"))
    one = F.col("size") == 1
    lists = {"starts": found(~one), "foreign": found(~one, other), "ones": found(one), "foreign_ones": found(one, other)}
    return later.groupBy("id", "text_hash").agg(*(c.alias(n) for n, c in lists.items()))


def _judged(df: DataFrame, id_col: str, text_col: str, run: int, alone: int | None) -> DataFrame:
    """(other: struct of the columns but the text, text: what is left of it, n_lines, n_removed, n_runs, n_foreign)."""
    alone = alone if run > 1 else None  # every line is a run then
    lists = repeated_runs(df, id_col, text_col, run, alone).withColumnsRenamed({"id": "of_id", "text_hash": "of_hash"})
    own = [column(c).alias(c) for c in df.columns if c != text_col]
    rows = df.select(F.struct(*own).alias("other"), column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("text_hash"), column(text_col).alias("text"))
    # Hashing the lists, not sorting the texts: these only stream by.
    out = rows.join(lists.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    none = F.array().cast("array<int>")
    covered = lambda starts: F.array_distinct(F.flatten(F.transform(F.coalesce(starts, none), lambda a: F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda k: a + k))))
    joined = lambda starts, ones: F.array_distinct(F.concat(covered(F.col(starts)), F.coalesce(F.col(ones), none))) if alone else covered(F.col(starts))
    out = fixed(out, lines=F.split("text", "\n"), gone=joined("starts", "ones"), elsewhere=joined("foreign", "foreign_ones"))
    start = F.struct(F.lit(0).alias("next"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("runs"))

    def count(acc: Column, x: Column) -> Column:
        new = F.when(acc["last"].eqNullSafe(x - 1), 0).otherwise(1)
        return F.struct(acc["next"].alias("next"), x.alias("last"), (acc["runs"] + new).alias("runs"))

    kept = F.array_join(F.transform(F.array_except(places(F.size("lines")), F.col("gone")), lambda k: F.get("lines", k)), "\n")
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")), "n_removed": F.size("gone"), "n_runs": F.aggregate(F.array_sort("gone"), start, count)["runs"], "n_foreign": F.size("elsewhere")}
    return out.select("other", F.when(F.size("gone") > 0, kept).otherwise(F.col("text")).alias("text"), *(c.cast("long").alias(n) for n, c in counts.items()))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, alone: int | None = None) -> DataFrame:
    """``df`` with later repeated runs of ``run`` or more lines, and later repeats of single lines of ``alone`` or more words (none, if None), deleted from the text, plus n_lines, n_removed, n_runs and n_foreign (removed lines that another text had first).

    Lines are split at line feeds; words of a line at ASCII white space. Order is by id (null last), text hash and line. Rows equal in id and text are one text and get the same
    result; a null text stays null with no lines; an empty text is one empty line. A text of which all lines go becomes empty. An empty table gives no rows. All other columns stay,
    whatever their names; a count whose name one of them has gets an underscore after it.
    """
    out = _judged(df, id_col, text_col, run, alone)
    own = [F.col("text").alias(c) if c == text_col else F.col("other").getField(c).alias(c) for c in df.columns]
    return out.select(*own, *(F.col(n).alias(free(n, df.columns)) for n in ("n_lines", "n_removed", "n_runs", "n_foreign")))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, run: int = 2, alone: int | None = 50) -> DataFrame:
    """``df`` with texts as ``dedup_lines`` leaves them, and without the rows of whose text nothing is left; the columns are those of ``df``.

    ``length_col``: a column that holds the text's length in characters and follows it where lines go, if there is such a column. Texts that were empty or null before stay.
    """
    out = _judged(df, id_col, text_col, run, alone).where("n_removed = 0 or text <> ''")

    def own(c: str) -> Column:
        if c == text_col:
            return F.col("text")
        before = F.col("other").getField(c)
        return F.when(F.col("n_removed") > 0, F.length("text").cast(df.schema[c].dataType)).otherwise(before) if c == length_col else before

    return out.select(*(own(c).alias(c) for c in df.columns))
