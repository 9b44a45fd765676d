"""Token similarities of names, 0 to 100, as Arrow-batched functions over pairs of columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit row at a time."""
    if len(a) > len(b):
        a, b = b, a
    place: dict[str, int] = {}
    for k, ch in enumerate(a):
        place[ch] = place.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & place.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times the share of characters that insertions and deletions leave alone."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 if the tokens of one are all in the other; else the best of the common tokens and either side's all."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    join = lambda rest: f"{both} {rest}" if both else rest
    best = ratio(join(only_x), join(only_y))
    return max(best, ratio(both, join(only_x)), ratio(both, join(only_y))) if both else best


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def _pairwise(f):
    def of(left: Column | str, right: Column | str) -> Column:
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            seen: dict[tuple[str, str], float] = {}
            out = []
            for p in zip(a, b, strict=True):
                if p[0] is None or p[1] is None:
                    out.append(None)
                else:
                    out.append(seen[p] if p in seen else seen.setdefault(p, f(*p)))
            return pd.Series(out, dtype="float64")

        return run(left, right)

    return of


#: Of texts whose tokens are sorted.
sorted_ratio = _pairwise(ratio)
token_sort = _pairwise(token_sort_ratio)
token_set = _pairwise(token_set_ratio)
sequence = _pairwise(sequence_ratio)
