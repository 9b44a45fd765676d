"""Product codes of vectors, their codebooks found by rounds of means, with annular norm pruning.

A vector is cut into equal parts; a part's code is its codebook's nearest entry. Entries are sorted by norm. An entry at distance d from a part has a
norm within d of the part's norm, so with the distance to the entry nearest in norm as the best so far, a binary search gives the interval of norms that can still win;
only entries in it, both ends included, are compared, exactly in integers. Vectors stay where they are staged: a round sends the codebooks out, whose size parameters fix, and brings back a sum for each entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covertree import whole_components
from .staging import stage, width
from .words import spread_join

#: Beyond it components aren't summed and squared as 64-bit integers but as Python's.
SAFE = 1 << 26


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's nearest entry, the lower index of equals. Integers of any size: beyond ``SAFE`` as objects."""
    large = max((int(abs(x).max()) for x in (points, entries) if x.size), default=0) > SAFE or points.shape[1] > 256
    kind = object if large else np.int64
    points, entries = points.astype(kind), entries.astype(kind)
    norm = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    by = np.argsort(norm(entries), kind="stable")
    norms, sought = norm(entries)[by], norm(points)
    after = np.searchsorted(norms, sought).clip(1, len(norms) - 1) if len(norms) > 1 else np.zeros(len(points), np.int64)
    start = np.where((len(norms) > 1) & (sought - norms[after - 1] < norms[after] - sought), after - 1, after)
    best = np.sqrt(((points - entries[by[start]]) ** 2).sum(axis=1).astype(np.float64))
    reach = best + 1e-9 * (best + sought + 1)  # rounding never leaves an entry out
    lo, hi = np.searchsorted(norms, sought - reach), np.searchsorted(norms, sought + reach, side="right")
    # The entries of all intervals, one after another, a bounded number of them at a time.
    code, found = np.empty(len(points), np.int64), np.empty(len(points), kind)
    sizes = hi - lo
    step = max(1, (1 << 20) // (len(entries) * max(1, points.shape[1])))
    for a in range(0, len(points), step):
        n = sizes[a : a + step]
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(a, a + len(n)), n)
        entry = by[np.repeat(lo[a : a + step] - first, n) + np.arange(int(n.sum()))]
        distance = ((points[row] - entries[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, first)
        tied = np.where(distance == np.repeat(least, n), entry, len(entries))
        code[a : a + step], found[a : a + step] = np.minimum.reduceat(tied, first), least
    return code, found


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """rows x parts x components."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, -1)


def train(vectors: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x components) after ``rounds`` of assigning the staged vectors ``v`` and replacing entries by floored means, from ``first`` on. An entry that no part is nearest to stays."""
    books = first
    parts, entries, size = books.shape

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
            for batch in batches:
                rows = _parts(batch, parts)
                exact = np.int64 if len(rows) == 0 or abs(rows.astype(np.float64)).max() * len(rows) < 2**62 else object
                for p in range(parts):
                    code, _ = nearest(rows[:, p], books[p])
                    order = np.argsort(code, kind="stable")
                    used, at = np.unique(code[order], return_index=True)
                    if len(used):
                        total[p, used] += np.add.reduceat(rows[order, p].astype(exact), at, axis=0).astype(object)
                        count[p] += np.bincount(code, minlength=entries)
            p, e = np.nonzero(count)
            flat = [int(x) for x in total[p, e].ravel()]
            cells = [np.repeat(p, size), np.repeat(e, size), np.tile(np.arange(size), len(p))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cells), pa.array(flat, pa.decimal128(38, 0)), pa.array(np.repeat(count[p, e], size), pa.int64())], ["part", "entry", "place", "total", "n"])

        # One row for each component of the codebooks: their number is fixed by parameters.
        found = vectors.select("v").mapInArrow(sums, "part int, entry int, place int, total decimal(38,0), n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in found:
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    return books


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096) -> DataFrame:
    """(id, code, error, label_error, codebooks): each vector's code, two hex digits a part, its squared error, that of all rows of its label, and the final codebooks as decimal integers with commas.

    Components become floor(scale x), saturating at those of 64 bits. Rows whose vector is null or holds null or non-finite components take no part, nor do empty vectors, rows without an id, and vectors whose
    length isn't that of the first row (the smallest id) or no multiple of ``parts``. Codebooks start as the parts of the ``entries`` smallest ids (rows of equal ids by their components), of all rows if there are fewer. Null labels are one
    label. Errors beyond 64 bits are given as the largest of them. An empty table gives no rows.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    kind = df.schema[id_col].dataType.simpleString()
    label = F.col(label_col)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(label.cast("string"), F.lit("")).alias("label"), label.isNull().alias("unlabelled"), whole_components(F.col(vector_col), scale).alias("v")).where("v is not null and id is not null")
    vectors = stage(rows, "vectors")
    heads = vectors.orderBy("id", "v").select("v").limit(entries).collect()
    size = len(heads[0].v) if heads else parts
    if size % parts:
        vectors, heads = vectors.where("false"), []
    elif any(len(h.v) != size for h in heads):
        heads = vectors.where(F.size("v") == size).orderBy("id", "v").select("v").limit(entries).collect()
    vectors = vectors.where(F.size("v") == size)
    first = np.array([h.v for h in heads], np.int64).reshape(len(heads), parts, size // parts).transpose(1, 0, 2)
    books = train(vectors, first, rounds) if heads else first
    top = (1 << 63) - 1

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [nearest(x, books[p]) for p, x in enumerate(_parts(batch, parts).transpose(1, 0, 2))] if batch.num_rows else []
            if got:
                code = np.stack([c for c, _ in got], axis=1).astype(np.uint8)
                error = sum(d.astype(object) for _, d in got)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes().hex() for c in code]), pa.array([min(int(e), top) for e in error], pa.int64())], ["id", "label", "unlabelled", "code", "error"])

    coded = stage(vectors.select("id", "label", "unlabelled", "v").mapInArrow(codes, f"id {kind}, label string, unlabelled boolean, code string, error long"), "codes")
    of_label = coded.groupBy("label", "unlabelled").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(top).cast("decimal(29,0)")).cast("long").alias("label_error"))
    text = ",".join(map(str, books.ravel().tolist()))
    out = spread_join(coded, of_label, ["label", "unlabelled"], ["id"], max(16, width(df.sparkSession)))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(text).alias("codebooks"))

