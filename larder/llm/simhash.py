"""SimHash near-duplicate groups by exact comparison of blocks.

Fingerprints are exact: every word shingle of the whole text votes. Distinct fingerprints are sorted by the
population counts of their parts and cut into blocks; every pair of blocks whose counts can be within the
radius meets in one task. It cuts fingerprints into parts of 16 bits: if two are within the radius, some part differs in few bits, so one
side is looked up by each part's keys, and only what it meets is compared. Small blocks, and those in which much is alike, are compared by
tiles with exclusive-or and bit counts instead, but for the tile pairs whose population counts differ by more than the radius (a
difference in population count is a lower bound of the Hamming distance). Both find every link.
A task returns a spanning forest of the links that it finds, not the links, so a group of k alike
fingerprints costs k rows; the components of all forests together are the components of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .bytehash import mix
from .components import connected_components
from .staging import stage
from .words import column, free

TILE = 128
PARTS = 4
#: Bits of a part that is looked up; rows that are looked up at once, and about how many pairs are compared at once beyond a key's first ones.
KEY, ROWS, AT_ONCE = 16, 1 << 14, 1 << 18


#: Odd factors that derive further hashes from a shingle's.
_FACTORS = [1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def text_fingerprint(text: bytes, shingle: int = 4, seed: int = 42, words: int = 1) -> list[int]:
    """The SimHash of one text, as unsigned 64-bit words; the first one's bits are those of the shingles' hashes, further ones' of mixed hashes. Zeros where there are no words."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return [0] * words
    joined = b" ".join(tokens)
    ends = list(accumulate(len(w) + 1 for w in tokens))
    starts = [0, *ends]
    last = max(1, len(tokens) - shingle + 1)
    spans = zip(starts[:last], ends[min(shingle, len(tokens)) - 1 :], strict=True)
    hashes = np.fromiter((xxh64_intdigest(joined[a : b - 1], seed) for a, b in spans), np.uint64, last)
    out = []
    for k in range(words):
        own = mix(hashes * np.uint64(_FACTORS[k])) if k else hashes
        votes = np.zeros(64, np.int64)
        for at in range(0, last, 65536):
            bits = np.unpackbits(own[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > last, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, words: int = 1) -> DataFrame:
    """(id, fp long, more array<long>): ``words`` words of 64 bits, all but the first in ``more``; a null text is a text without words."""
    kind = df.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.of("simhash")
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [text_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed, words) for t in texts]
            made = np.array(fps, np.uint64).reshape(-1, words).view(np.int64)
            more = pa.array(list(made[:, 1:]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(made[:, 0])), more], ["id", "fp", "more"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind.simpleString()}, fp long, more array<long>").withColumnRenamed("id", id_col)


def part_counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of PARTS equal parts of each fingerprint."""
    size = 64 // PARTS
    return np.stack([np.bitwise_count((fps >> np.uint64(size * k)) & np.uint64((1 << size) - 1)) for k in range(PARTS)]).astype(np.int16)


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the least vertex of its component."""
    lab = np.arange(n)
    while len(u):
        least = np.minimum(lab[u], lab[v])
        np.minimum.at(lab, lab[u], least)
        np.minimum.at(lab, lab[v], least)
        while (up := lab[lab]).tobytes() != lab.tobytes():
            lab = up
        keep = lab[u] != lab[v]
        u, v = u[keep], v[keep]
    return lab


def _ordered(x: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of words) by population counts of the first word and its parts."""
    return x[np.lexsort([x[:, 0], *part_counts(x[:, 0])[::-1], np.bitwise_count(x[:, 0])])]


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest counts of each tile: those of the first word's parts, of its last two parts together, and of each further word."""
    parts = part_counts(x[:, 0])
    counts = np.concatenate([parts, parts[-2:].sum(axis=0, keepdims=True), np.bitwise_count(x[:, 1:]).astype(np.int16).T])
    at = np.arange(0, len(x), TILE)
    return np.minimum.reduceat(counts, at, axis=1), np.maximum.reduceat(counts, at, axis=1)


def _least_distance(gap: np.ndarray) -> np.ndarray:
    """A lower bound of the distance from the gaps between two tiles' counts. In the order of the fingerprints a tile's last two parts vary together less than each."""
    apart, joined, more = gap[:PARTS].sum(axis=0), gap[: PARTS - 2].sum(axis=0) + gap[PARTS], gap[PARTS + 1 :].sum(axis=0)
    return np.maximum(apart, joined) + more


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile pair within the radius; further words only for pairs that the first two leave."""
    near = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
    if left.shape[1] > 1:
        near = near + np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
    x, y = np.nonzero(near <= radius)
    if left.shape[1] > 2 and len(x):
        keep = np.bitwise_count(left[x] ^ right[y]).sum(axis=1, dtype=np.int64) <= radius
        x, y = x[keep], y[keep]
    return x, y


def _allowed(radius: int, parts: int) -> list[int]:
    """Differing bits a part may have so that each pair within the radius has a part with no more; -1 where a part needn't be looked at. If every part had one more, the sum would pass the radius."""
    least, more = divmod(radius + 1, parts)
    return [least + (k < more) - 1 for k in range(parts)]


def _masks(most: int) -> np.ndarray:
    """All keys of a part with ``most`` bits or fewer, few bits first."""
    keys = np.arange(1 << KEY)
    bits = np.bitwise_count(keys)
    return keys[np.argsort(bits, kind="stable")][: np.count_nonzero(bits <= most)]


def _keys(x: np.ndarray) -> np.ndarray:
    """Each fingerprint's parts of KEY bits, a row a part."""
    return np.ascontiguousarray(np.ascontiguousarray(x).astype("<u8").view("<u2").reshape(len(x), -1).T).astype(np.int64)


def _lookup_pays(a: np.ndarray, b: np.ndarray, masks: list[np.ndarray]) -> bool:
    """Whether looking parts up costs less than comparing all tiles. The pairs that it would compare are reckoned from some of the rows; both ways find the same links."""
    step, met, probes = max(1, -(-len(a) // 4096)), 0, sum(map(len, masks))
    for ka, kb, own in zip(_keys(a[::step]), _keys(b), masks, strict=True):
        n = np.bincount(kb, minlength=1 << KEY)
        for at in range(0, len(ka), 256):
            met += int(n[ka[at : at + 256, None] ^ own].sum())
    return probes * (10_000 + len(a)) + 4 * met * step < len(a) * len(b)


def _beyond(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for each row's ``n`` places from ``first``, about AT_ONCE together."""
    rows = np.nonzero(n > 0)[0]
    first, n = first[rows], n[rows]
    ends = np.cumsum(n)
    cuts = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE), side="right").tolist() if len(ends) else []
    for lo, hi in pairwise([0, *cuts, len(rows)]):
        if lo < hi:
            before = ends[lo:hi] - n[lo:hi]
            yield np.repeat(rows[lo:hi], n[lo:hi]), np.repeat(first[lo:hi] - before, n[lo:hi]) + np.arange(before[0], ends[hi - 1])


def _together(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, little more than AT_ONCE at a time."""
    held, n = [], 0
    for x, y in pairs:
        held.append((x, y))
        n += len(x)
        if n > AT_ONCE:
            yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def _near_in_part(a: np.ndarray, b: np.ndarray, part: int, masks: np.ndarray, radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that differ by one of ``masks`` in the part, and by ``radius`` bits at most in two words. Sides are sorted by the part.

    The first ``wide`` fingerprints of each key of b stand in as many columns, a key a row; empty places hold any fingerprint, so some pairs that come don't differ by a mask.
    """
    words, wide = a.shape[1], min(8, 1 + int(1.5 * len(b) / (1 << KEY)))
    ka, n = _keys(a)[part], np.bincount(_keys(b)[part], minlength=1 << KEY)
    start, full = np.cumsum(n) - n, n > wide
    place = [np.where(slot < n, start + slot, 0) for slot in range(wide)]
    # The words without the part tell more.
    first = [(part * KEY // 64 + 1 + i) % words for i in range(min(2, words))]
    left, right = ([np.ascontiguousarray(z[:, w]) for w in first] for z in (a, b))
    table = [[x[p] for x in right] for p in place]

    def near(x: np.ndarray | slice, others: list[np.ndarray]) -> np.ndarray:
        bits = [np.bitwise_count(q[x] ^ o) for q, o in zip(left, others, strict=True)]
        return (bits[0] + bits[1] if len(bits) > 1 else bits[0]) <= radius

    for mask in masks.tolist():
        asked = ka ^ mask
        rows = np.nonzero(asked > ka)[0] if own and mask else None  # of a side with itself each pair once
        for at in range(0, len(ka) if rows is None else len(rows), ROWS):
            here = slice(at, at + ROWS) if rows is None else rows[at : at + ROWS]
            keys = asked[here]
            for p, held in zip(place, table, strict=True):
                i = np.nonzero(near(here, [t.take(keys, mode="wrap") for t in held]))[0]
                if len(i):
                    yield i + at if rows is None else here[i], p[keys[i]]
        more = np.nonzero(full[asked])[0] if rows is None else rows[full[asked[rows]]]
        for i, y in _beyond(start[asked[more]] + wide, n[asked[more]] - wide):
            keep = near(more[i], [r[y] for r in right])
            yield more[i[keep]], y[keep]


def _looked_up(a: np.ndarray, b: np.ndarray, masks: list[np.ndarray], radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within the radius, some of them more than once: only pairs that are near in a part are compared."""
    for part, (ka, kb, near_keys) in enumerate(zip(_keys(a), _keys(b), masks, strict=True)):
        by_a, by_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        left, right = a[by_a], b[by_b]
        for x, y in _together(_near_in_part(left, right, part, near_keys, radius, own)):
            keep = np.bitwise_count(left[x] ^ right[y]).sum(axis=1, dtype=np.int64) <= radius
            yield by_a[x[keep]], by_b[y[keep]]


def _by_tiles(a: np.ndarray, b: np.ndarray, radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within the radius, of ordered fingerprints; every tile of a is compared with every one of b that its counts leave."""
    (lo_a, hi_a), (lo_b, hi_b) = _boxes(a), _boxes(b)
    for i in range(lo_a.shape[1]):
        gap = np.maximum(0, np.maximum(lo_b - hi_a[:, i : i + 1], lo_a[:, i : i + 1] - hi_b))
        left = a[i * TILE : (i + 1) * TILE]
        for j in np.nonzero(_least_distance(gap) <= radius)[0]:
            if not own or j >= i:
                x, y = _close(left, b[j * TILE : (j + 1) * TILE], radius)
                yield x + i * TILE, y + j * TILE


def close_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius, of a with b or of a with itself, by first words. Fingerprints are words, or rows of words."""
    own = b is None
    a = _ordered(a.reshape(len(a), -1))
    b = a if own else _ordered(b.reshape(len(b), -1))
    both = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    masks = [_masks(most) for most in _allowed(radius, a.shape[1] * 64 // KEY)]
    if not own and len(a) > len(b):
        pairs = _looked_up(b, a, masks, radius, own) if _lookup_pays(b, a, masks) else None
        pairs = ((y, x) for x, y in pairs) if pairs else None
    else:
        pairs = _looked_up(a, b, masks, radius, own) if _lookup_pays(a, b, masks) else None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lab, held = np.arange(len(both)), 0
    for x, y in pairs or _by_tiles(a, b, radius, own):
        y = y + shift
        keep = lab[x] != lab[y]
        if keep.any():
            found.append((x[keep], y[keep]))
            held += int(keep.sum())
        if held > 1_000_000:
            lab, found, held = _merge(lab, found), [], 0
    lab = _merge(lab, found)
    inner = np.nonzero(lab != np.arange(len(both)))[0]
    return both[inner, 0], both[lab[inner], 0]


def _merge(lab: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    if not found:
        return lab
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return spanning(lab[u], lab[v], len(lab))[lab]


def links(distinct: DataFrame, radius: int = 4, block: int | None = None, words: int = 1) -> DataFrame:
    """``distinct``: (fp long, more array<long>), each fp once. Returns a set of links (u, v) within the radius that connects all that are linked.

    ``block``: fingerprints a block; by default a twelfth of them, between 4,096 and 131,072, so a task holds 2 MB of
    them at most and a fingerprint is sent to (number of blocks) tasks.
    """
    spark = distinct.sparkSession
    distinct = stage(distinct, "fingerprints")
    n = distinct.count()
    size = block or min(131072, max(4096, n // 12))
    part = 64 // PARTS

    def count(k: int) -> Column:
        return F.bit_count(F.shiftrightunsigned("fp", part * k).bitwiseAND(F.lit((1 << part) - 1)))

    keyed = distinct.withColumn("pop", F.bit_count("fp"))
    dealt = keyed.repartitionByRange(max(1, -(-n // size)), "pop", *(count(k) for k in range(PARTS)), "fp").select("fp", "more")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        got = [np.column_stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, words - 1)]) for b in batches if b.num_rows]
        fps = _ordered(np.concatenate(got).view(np.uint64)) if got else np.zeros((0, words), np.uint64)
        for k, at in enumerate(range(0, len(fps), 2 * size)):
            own = fps[at : at + 2 * size]
            pops = np.bitwise_count(own[:, 0])
            row = [here * 100000 + k, int(pops.min()), int(pops.max()), len(own), own.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row[:4]] + [pa.array([row[4]], pa.binary())], ["piece", "low", "high", "n", "data"])

    pieces = stage(dealt.mapInArrow(pack, "piece long, low long, high long, n long, data binary"), "blocks")
    # One small row a piece. Neighbouring pieces make a block, however small the partitions were; a block meets the later ones whose counts can be within the radius.
    known = pieces.select("piece", "low", "high", "n").orderBy("piece").collect()
    member: list[tuple[int, int]] = []
    blocks: list[list[int]] = []
    for x in known:
        if not blocks or blocks[-1][2] + x.n > size * 3 // 2:
            blocks.append([x.low, x.high, 0])
        last = blocks[-1]
        last[0], last[1], last[2] = min(last[0], x.low), max(last[1], x.high), last[2] + x.n
        member.append((x.piece, len(blocks) - 1))
    reach = [max(j for j in range(k, len(blocks)) if blocks[j][0] - b[1] <= radius) for k, b in enumerate(blocks)]
    first = [min(i for i in range(k + 1) if reach[i] >= k) for k in range(len(blocks))]
    plan = spark.createDataFrame([(p, k, first[k], reach[k]) for p, k in member], "piece long, k int, first int, last int")
    sent = pieces.join(F.broadcast(plan), "piece").select("k", "piece", "data", F.explode(F.sequence("first", "last")).alias("other"))
    sent = sent.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b"), "k", "data")

    def compare(table: pa.Table) -> pa.Table:
        caches.of("simhash")
        sides: dict[int, list[np.ndarray]] = {}
        for k, x in zip(table.column("k").to_pylist(), table.column("data").to_pylist(), strict=True):
            sides.setdefault(k, []).append(np.frombuffer(x, np.uint64).reshape(-1, words))
        data = [np.concatenate(sides[k]) for k in sorted(sides)]
        u, v = close_forest(data[0], data[1] if len(data) > 1 else None, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    pairs = sum(r - k + 1 for k, r in enumerate(reach))
    sent = sent.repartition(min(max(pairs, 1), 8192), "a", "b")
    return sent.groupBy("a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42, block: int | None = None, words: int = 1
) -> DataFrame:
    """(id, fingerprint, component_id): one row a row of ``df``.

    ``component_id`` is the smallest id that is reachable over links of at most ``radius`` differing bits, the row's own included. Null or
    wordless texts have fingerprint zero, which is linked like any other. Rows with equal ids stay separate rows; a null id is never
    the smallest unless a group has no other. An empty table gives no rows. Other columns of ``df`` are ignored.
    ``words``: 64-bit words a fingerprint has; the radius is over all of them. The first word names a fingerprint: texts equal in it are linked.
    """
    marked = stage(fingerprints(df, id_col, text_col, shingle, seed, words), "simhash")
    groups = marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.min("more").alias("more"))
    roots = connected_components(links(groups.select("fp", "more"), radius, block, words))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = marked.join(classes, "fp")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def radius_for(similarity: float, words: int) -> int:
    """Differing bits to expect of two texts whose shingle sets have this Jaccard similarity, plus half a standard deviation."""
    j = 2 * similarity / (1 + similarity)  # cosine of two sets of equal size
    share, bits = math.acos(j) / math.pi, 64 * words
    return round(share * bits + 0.5 * math.sqrt(bits * share * (1 - share)))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 4, **how) -> DataFrame:
    """``df`` without the rows that are not the first of their near-duplicate group; all columns stay.

    Texts are linked if fingerprints of 256 bits over shingles of five words put their similarity at 0.8 or more. The first is the row of the smallest id (a null id comes
    last), then of the smallest text hash; of rows that are equal in both, one stays. All wordless texts, null ones included, are one group. An empty table gives no rows.
    Columns may have any names.
    """
    key, name = free("key", df.columns), free("first", df.columns)
    keyed = df.withColumn(key, F.struct(column(id_col).isNull().alias("n"), column(id_col).alias("i"), F.xxhash64(column(text_col)).alias("x")))
    classes = near_duplicates(keyed.select(column(key).alias("_key"), column(text_col).alias("_text")), "_key", "_text", shingle, radius_for(similarity, words), words=words, **how)
    first = stage(classes.where("_key <=> component_id").groupBy("_key").agg(F.count("*").alias("n")), "firsts")
    kept = keyed.join(first.select(F.col("_key").alias(name)).hint("shuffle_hash"), column(key).eqNullSafe(column(name)), "left_semi")
    # Only rows that are equal in id and text need a choice, for which texts would have to be sorted.
    return (kept.dropDuplicates([key]) if first.where("n > 1").limit(1).count() else kept).drop(key)
