"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

A byte-level merge needs as many refinement rounds over all text as the repeat is long (400). Here the texts are first routed and parsed by content, so that few rounds
over few symbols do:

1. Every string of ``length`` bytes holds an anchor: the k-gram of least hash in it. Equal strings hold equal anchors, so only anchors
   that occur in more than one place matter, and each sends the bytes about it, which hold all strings it is the anchor of.
2. A task takes whole groups of equal anchors. It cuts the segments into phrases where a gram of the text itself says so, numbers the phrases in the order of their bytes, and
   splits the segments into shards, each with the Burrows-Wheeler transform of its phrase strings. The transforms are merged by refining the interleave round by
   round; no suffixes are sorted across shards. The round in which a boundary appears gives the phrases that two neighbouring suffixes have in common, and the bytes of the first phrase in which they
   differ complete the common prefix.
3. Places that stand alike before a cut (equal bytes up to it) are in the order of the suffixes at their cuts. Neighbours among them whose common prefix reaches ``length`` bytes
   form an interval, and the intervals that hold two different places of the texts are the repeats: they decide what goes. A byte check of what they say follows, as the bytes before a cut are compared by hash.

An anchor in more than ``HOT`` places, which would make one task large, goes another way: the strings it is the anchor of are hashed and counted in Spark, where equal ones are merged before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .bytehash import Spans, minimizers
from .staging import stage
from .words import spread_join

GRAM, PHRASE_GRAM, PHRASE_WINDOW, SHARDS = 96, 16, 64, 4
PERIOD = 8
#: Bytes from a cut on that decide whether it is one.
CONTEXT = PHRASE_GRAM + PERIOD - 1
HOT = 4096
CHUNK = 1 << 20
TASK_BYTES = 8 << 20
PIECE = 1 << 20


def _thin(places: np.ndarray, grams: np.ndarray, w: int) -> list[int]:
    """Of equal grams, enough that every window of w of which they are the least keeps one."""
    keep: list[int] = []
    last: dict[int, int] = {}
    waiting: dict[int, int] = {}
    for p, g in zip(places.tolist(), grams.tolist(), strict=True):
        if g in last and p > last[g] + w and g in waiting:
            last[g] = waiting.pop(g)
            keep.append(last[g])
        if g not in last or p > last[g] + w:
            last[g] = p
            keep.append(p)
        else:
            waiting[g] = p
    return sorted([*keep, *waiting.values()])


def anchors(text: bytes, length: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash): every string of ``length`` bytes of the text holds one that is its least k-gram."""
    w = length - GRAM + 1
    places, hashes = [], []
    for a in range(0, max(1, len(text) - length + 1), CHUNK):
        grams = Spans(np.frombuffer(text[a : a + CHUNK + length - 1], np.uint8)).rolling(GRAM)
        at = minimizers(grams, w)
        if len(at) > 1 and len(np.unique(grams[at])) < len(at):
            at = np.array(_thin(at, grams[at], w), np.int64)
        places.append(at + a)
        hashes.append(grams[at])
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def transform(strings: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform) of phrase strings (symbols from 1), each followed by an end of its own that is below all symbols; 0 stands for an end."""
    n = len(strings) + len(ends)
    text = np.zeros(n, np.int64)
    stops = ends + np.arange(len(ends))
    inner = np.ones(n, bool)
    inner[stops] = False
    text[inner] = strings
    rank = np.where(inner, text + len(ends), np.cumsum(~inner) - 1)
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[:-step] = rank[step:]
        order = np.lexsort((ahead, rank))
        new = np.concatenate([[False], (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.sum() == n - 1 or step >= n:
            break
        step *= 2
    before = np.where(order > 0, text[order - 1], 0)
    return order, before


def _refined(transforms: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source, new) after each round of refinement: from which transform each suffix in the merged order comes, and where an interval of suffixes begins that have as many first symbols in common, none of them an end."""
    source = np.repeat(np.arange(len(transforms), dtype=np.int8), [len(t) for t in transforms])
    interval = np.zeros(len(source), np.int64)
    while True:
        symbol = np.empty(len(source), np.int64)
        for k, t in enumerate(transforms):
            symbol[source == k] = t
        small = symbol.max(initial=0) < 1 << 16
        order = np.argsort(symbol.astype(np.uint16) if small else symbol, kind="stable")
        symbol, source, interval = symbol[order], source[order], interval[order]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]) | (symbol[1:] == 0)
        interval = np.cumsum(new)
        yield source, new


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval) after some rounds of refinement.

    The interleave says from which transform each suffix in the merged order comes; suffixes of one interval have their first ``rounds`` symbols in common, none of
    them an end.
    """
    for (source, new), _ in zip(_refined(transforms), range(rounds), strict=False):
        pass
    return source, np.cumsum(new)


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of segments of about PIECE bytes: what is worked out byte by byte is held for one piece at a time."""
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PIECE, side="right")) - 1)
        yield lo, hi
        lo = hi


class Parse:
    """The cuts of segments, with the order and the common prefixes of the suffixes that begin at them.

    ``place``: where phrases begin, and where segments end, in ``data`` (segments with one byte between them); ``stop``: the end of the segment; ``rank``: the suffix's place
    in the merged order; ``prefix[r]``: the bytes, ``length`` at most, that suffix r has in common with suffix r - 1.
    """

    def __init__(self, raw: bytes, starts: np.ndarray, length: int):
        data = np.frombuffer(raw, np.uint8)
        ends = starts[1:] - 1
        cuts = []
        for lo, hi in _pieces(starts):
            grams = Spans(data[starts[lo] : ends[hi - 1]]).rolling(PHRASE_GRAM)
            n = max(0, len(grams) - PERIOD + 1)
            # In a stretch of a short period nothing is cut, else its phrases would be as many as its bytes.
            found = grams[:n] % np.uint64(PHRASE_WINDOW) == 0
            for k in range(1, PERIOD):
                found &= grams[:n] != grams[k : k + n]
            at = np.nonzero(found)[0] + starts[lo]
            cuts.append(at[at + CONTEXT <= ends[np.searchsorted(starts, at, side="right") - 1]])
        cuts = np.concatenate(cuts)
        self.place = np.sort(np.concatenate([cuts, ends]))
        own = np.searchsorted(starts, self.place, side="right") - 1
        self.start, self.stop = starts[own], ends[own]
        self.last = self.place == self.stop
        follow = np.minimum(np.append(self.place[1:], 0) + CONTEXT, self.stop)
        # Phrases up to the end of what decides the next cut: none begins with another, so their order is that of the texts.
        texts = [raw[x:y] for x, y, end in zip(self.place.tolist(), follow.tolist(), self.last.tolist(), strict=True) if not end]
        number = {t: k for k, t in enumerate(sorted(set(texts)), 1)}
        symbols = np.zeros(len(self.place), np.int64)
        symbols[~self.last] = [number[t] for t in texts]
        at, transforms, order = np.nonzero(self.last)[0], [], []
        bounds = np.linspace(0, len(starts) - 1, SHARDS + 1).astype(np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo < hi:
                x, y = (at[lo - 1] + 1 if lo else 0), at[hi - 1] + 1
                own, stops = symbols[x:y], at[lo:hi] - x
                suffixes, before = transform(own[~self.last[x:y]], stops - np.arange(hi - lo))
                order.append(suffixes + x)
                transforms.append(before)
        suffix, common = self._merged(order, transforms, length)
        self.rank = np.empty(len(suffix), np.int64)
        self.rank[suffix] = np.arange(len(suffix))
        self.prefix = self._prefixes(data, suffix, common, length)

    def _merged(self, order: list[np.ndarray], transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in the merged order, phrases that each has in common with the one before), refined until what is alike is ``length`` bytes long."""
        suffix = np.empty(len(self.place), np.int64)
        common = np.full(len(suffix), -1, np.int64)
        for done, (source, new) in enumerate(_refined(transforms), 1):
            common[new & (common < 0)] = done - 1
            alike = np.nonzero(~new)[0]
            if done % 4 == 0 or len(alike) == 0:
                for k, o in enumerate(order):
                    suffix[source == k] = o
                if len(alike) == 0 or (self.place[suffix[alike] + done] - self.place[suffix[alike]]).min() >= length:
                    common[common < 0] = done
                    return suffix, common

    def _prefixes(self, data: np.ndarray, suffix: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(suffix), np.int64)
        u, v = suffix[:-1], suffix[1:]
        have = self.place[u + common[1:]] - self.place[u]
        room = np.minimum(np.minimum(self.stop[u] - self.place[u], self.stop[v] - self.place[v]), length)
        u, v, wide = self.place[u], self.place[v], np.arange(16)
        todo = np.nonzero(have < room)[0]
        while len(todo):
            ahead = have[todo, None] + wide
            inside = ahead < room[todo, None]
            ahead = np.where(inside, ahead, 0)
            alike = (data[u[todo, None] + ahead] == data[v[todo, None] + ahead]) & inside
            full = alike.all(axis=1)
            have[todo] += np.where(full, 16, alike.argmin(axis=1))
            todo = todo[full]
        out[1:] = np.minimum(have, room)
        return out

    def alike(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The bytes that the suffixes of ranks low < high have in common: the least prefix between them."""
        table = [self.prefix.astype(np.int16)]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        span = high - low
        level = np.frexp(span.astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(table[k][low[here] + 1], table[k][high[here] - (1 << int(k)) + 1])
        return out


def intervals(raw: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, interval): the strings of ``length`` bytes of the segments [starts[k], starts[k + 1] - 1) that may have an equal, those of one interval being equal."""
    parse = Parse(raw, starts, length)
    data = np.frombuffer(raw, np.uint8)
    follows = np.append(True, parse.last[:-1])
    first = np.where(follows, parse.start, np.append(0, parse.place[:-1]) + 1)
    most = np.maximum(parse.prefix, np.append(parse.prefix[1:], 0))[parse.rank]
    last = np.minimum(parse.place, parse.stop - length)
    # Strings with a cut that all their equals have, by their bytes before it: as far before as its suffix's common prefix allows.
    a_lo, a_hi = np.maximum(first, parse.place - (length - CONTEXT)), np.where(parse.last, -1, np.minimum(last, parse.place - (length - most)))
    # The others are compared as a whole.
    b_lo, b_hi = first, np.where(parse.last, last, np.minimum(last, parse.place - (length - CONTEXT) - 1))

    def listed(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.maximum(0, hi - lo + 1)
        cut = np.repeat(np.arange(len(lo)), count)
        return cut, np.arange(len(cut)) - np.repeat(np.cumsum(count) - count, count) + lo[cut]

    (cut, at), (_, whole) = listed(a_lo, a_hi), listed(b_lo, b_hi)
    places = np.concatenate([at, whole])
    ends = np.concatenate([parse.place[cut], whole + length])
    rank = np.concatenate([parse.rank[cut], np.full(len(whole), -1)])
    need = np.concatenate([length - (parse.place[cut] - at), np.zeros(len(whole), np.int64)])
    key = np.empty(len(places), np.uint64)
    by = np.argsort(places)
    for lo, hi in _pieces(starts):
        x, y = np.searchsorted(places, [starts[lo], starts[hi]], sorter=by)
        if x < y:
            here = by[x:y]
            key[here] = Spans(data[starts[lo] : starts[hi] - 1]).at(places[here] - starts[lo], ends[here] - starts[lo])
    key ^= (rank < 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((rank, key))
    key, rank, need, places = key[order], rank[order], need[order], places[order]
    same = key[1:] == key[:-1]
    check = np.nonzero(same & (rank[1:] > rank[:-1]))[0]
    same[check] = parse.alike(rank[check], rank[check + 1]) >= need[check + 1]
    several = np.append(False, same) | np.append(same, False) if len(places) else same
    return places[several], np.cumsum(np.append(True, ~same))[: len(places)][several]


def repeats(texts: np.ndarray, places: np.ndarray, segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, end) of the runs of strings of ``length`` bytes that start in another place too.

    A segment is ``segments[k]``, from byte places[k] of text number texts[k]; segments may overlap.
    """
    none = np.zeros(0, np.int64)
    keep = np.nonzero([len(s) >= length for s in segments])[0]
    if len(keep) < 2:
        return none, none, none
    segments = [segments[k] for k in keep]
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in segments])])
    raw = b"\0".join([*segments, b""])
    at, key = intervals(raw, starts, length)
    if len(at) == 0:
        return none, none, none
    which = np.searchsorted(starts, at, side="right") - 1
    where = (texts[keep][which] << 40) + places[keep][which] + at - starts[which]
    by = np.lexsort((where, key))
    at, key, where = at[by], key[by], where[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.nonzero(new)[0]
    run = np.cumsum(new) - 1
    last = np.concatenate([first[1:], [len(at)]]) - 1
    twice = where[first[run]] != where[last[run]]
    shift = (at[np.where(where == where[first[run]], last[run], first[run])] - at)[twice]
    at = at[twice]
    by = np.argsort(at)
    at, shift = at[by], shift[by]
    # Byte check, a run of neighbours with one shift at a time.
    cut = np.nonzero((np.diff(at) != 1) | (np.diff(shift) != 0))[0] + 1
    good = np.ones(len(at), bool)
    view = memoryview(raw)
    for x, y in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(at)]]).tolist(), strict=True):
        if x < y:
            a, b, s = int(at[x]), int(at[y - 1]) + length, int(shift[x])
            if view[a:b] != view[a + s : b + s]:
                good[x:y] = [view[p : p + length] == view[p + s : p + s + length] for p in range(a, b - length + 1)]
    at = at[good]
    if len(at) == 0:
        return none, none, none
    cut = np.nonzero(np.diff(at) != 1)[0] + 1
    x, y = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    seg = np.searchsorted(starts, x, side="right") - 1
    return keep[seg], places[keep[seg]] + x - starts[seg], places[keep[seg]] + y - starts[seg] + length


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _segments(df: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(routed segments, those of hot anchors if there are any, texts of them) from df (id, key, text, first id of the key)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.of("sadedup")
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                found = [anchors(t.as_buffer().to_pybytes(), length) for t in batch.column(1).cast(pa.large_binary())]
                take = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
                at, h = (np.concatenate(x) if found else np.zeros(0) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(at.astype(np.int64)), pa.array(h.view(np.int64))], ["key", "at", "anchor"])

    long = df.where(F.octet_length("text") >= length)
    marks = stage(long.select("key", "text").mapInArrow(mark, "key binary, at long, anchor long"), "anchors")
    place = F.struct("key", "at")
    again = marks.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a <> b").select("anchor", (F.col("n") > HOT).alias("hot"))
    lists = spread_join(marks, again, ["anchor"], ["key", "at"], 8).groupBy("key").agg(F.collect_set(F.struct("at", "anchor", "hot")).alias("marks"))
    first = df.groupBy("key").agg(F.min("id").alias("id"))
    lists = lists.join(first, "key").select(F.col("key").alias("_key"), F.col("id").alias("_id"), "marks")
    own = long.join(lists.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("key", "text", "marks")
    own = stage(own, "marked-texts")

    def cut(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                rows, anchor, start, data, mark = [], [], [], [], []
                for k, (text, marks) in enumerate(zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True)):
                    raw = text.as_buffer().to_pybytes()
                    for m in marks:
                        if m["hot"] != hot:
                            continue
                        lo = max(0, m["at"] - (length - GRAM))
                        rows.append(k)
                        anchor.append(m["anchor"])
                        start.append(lo)
                        data.append(raw[lo : m["at"] + length])
                        mark.append(hashlib.blake2b(data[-1], digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(anchor, pa.int64()), pa.array(start, pa.int64()), pa.array(data, pa.binary()), pa.array(mark, pa.binary())], ["key", "anchor", "start", "data", "mark"])

    kind = "key binary, anchor long, start long, data binary, mark binary"
    about = own.where(F.exists("marks", lambda m: m["hot"]))
    hot = None if about.isEmpty() else about.mapInArrow(partial(cut, hot=True), kind)
    return own.mapInArrow(partial(cut, hot=False), kind), hot, own.select("key", "text")


def _hot(segments: DataFrame, length: int) -> DataFrame:
    """(key, a, b): covered intervals of the segments of hot anchors. No anchor's segments are gathered: equal segments, then equal strings of ``length`` bytes, are counted by hashes of 128 bits."""
    segments = stage(segments, "hot-segments")
    place = lambda at: F.struct("key", at)
    ends = lambda at: (F.min(place(at)).alias("first"), F.max(place(at)).alias("last"))
    equal = stage(segments.groupBy("anchor", "mark").agg(*ends("start")), "hot-marks")
    sizes = segments.select("key", "anchor", "start", "mark", F.octet_length("data").alias("size")).where(F.col("size") >= length)
    whole = spread_join(sizes, equal.where("first <> last").select("anchor", "mark"), ["anchor", "mark"], ["key", "start"])
    whole = whole.select("key", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    # One segment stands for all that are equal to it.
    chosen = segments.join(equal.select("anchor", "mark", "first.key", "first.start"), ["key", "start", "anchor", "mark"], "left_semi")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = length // 2
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                rows, at, h1, h2 = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for row, (start, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.large_binary()), strict=True)):
                    spans = Spans(np.frombuffer(data.as_buffer(), np.uint8))
                    n = max(0, len(data.as_buffer()) - length + 1)
                    rows += [row] * n
                    at.append(np.arange(start, start + n))
                    h1.append(spans.rolling(half)[:n])
                    h2.append(spans.rolling(length - half)[half : half + n])
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(at)), *(pa.array(np.concatenate(h).view(np.int64)) for h in (h1, h2))], ["key", "anchor", "at", "h1", "h2"])

    parts = stage(chosen.select("key", "anchor", "start", "data").mapInArrow(strings, "key binary, anchor long, at long, h1 long, h2 long"), "hot-strings")
    again = parts.groupBy("anchor", "h1", "h2").agg(*ends("at")).where("first <> last").select("anchor", "h1", "h2")
    found = spread_join(parts, again, ["anchor", "h1", "h2"], ["key", "at"])
    return whole.unionAll(found.select("key", F.col("at").alias("a"), (F.col("at") + length).alias("b")))


def _found(segments: DataFrame, length: int) -> DataFrame:
    """(key, a, b): covered intervals of texts."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names = {k: n for n, k in enumerate(dict.fromkeys(r[0] for r in rows))}
        seg, a, b = repeats(np.array([names[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), [r[3] for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in seg.tolist()], pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[2] + len(r[3]) for r in rows], pa.int64())], ["key", "a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal segments of a group come one after another: each is covered by the others, and one stands for all.
        rows: list[tuple] = []
        again: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(row[3]) < length:
                    continue
                if last is not None and row[1] == last[1] and row[3] == last[3]:
                    if (row[0], row[2]) != (last[0], last[2]):
                        again += [row, last]
                    if len(again) > 2000:
                        yield whole(again)
                        again = []
                    continue
                if held > TASK_BYTES and row[1] != last[1]:
                    yield solve(rows)
                    rows, held = [], 0
                last = row
                rows.append(row)
                held += len(row[3])
        if again:
            yield whole(again)
        if rows:
            yield solve(rows)

    return segments.repartition("anchor").sortWithinPartitions("anchor", "mark", "key", "start").mapInArrow(work, "key binary, a long, b long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256 [, kept binary]): one row a row of ``df``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or another, overlaps included; strings don't cross rows and are
    judged on the input. ``n_spans``: maximal removed runs. A null text is empty; texts below ``length`` bytes stay whole; every copy of a
    repeated text goes, rows that are equal in everything included. ``length`` is above 119.
    """
    if length <= GRAM + CONTEXT:
        raise ValueError("length is too small for anchors and phrases")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), _text_key(text).alias("key"), text.alias("text"))
    base = stage(docs.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    copies = base.groupBy("key").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n"))
    segments, hot, texts = _segments(docs, length)
    found = _found(segments, length)
    spans = (found.unionAll(_hot(hot, length)) if hot is not None else found).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("found"))
    # Texts that occur once and lose something; of the others it is known what stays.
    single = copies.where("copies = 1").select("key")
    spans = stage(spans.join(single, "key", "left_semi"), "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, shas, kept = [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                raw, end, parts, n, gone = text.as_buffer().to_pybytes(), 0, [], 0, 0
                for s in found:
                    if s["a"] > end or n == 0:
                        parts.append(raw[end : s["a"]])
                        n += 1
                        gone += s["b"] - s["a"]
                    else:
                        gone += max(0, s["b"] - end)
                    end = max(end, s["b"])
                rest = b"".join([*parts, raw[end:]])
                removed.append(gone)
                runs.append(n)
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["key", "gone", "runs", "rest_sha", "rest"])

    part = texts.join(spans.hint("shuffle_hash"), "key").mapInArrow(keep, "key binary, gone long, runs long, rest_sha string, rest binary")
    whole = copies.where((F.col("copies") > 1) & (F.col("n") >= length)).select("key", F.lit(True).alias("all_gone"))
    out = base.join(whole, "key", "left").join(part, "key", "left")
    gone = F.col("all_gone").isNotNull()
    made = [
        F.col("id").alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest_sha", "sha")).alias("kept_sha256"),
    ]
    if with_kept:
        source = docs.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("text").cast("binary").alias("_text")).dropDuplicates(["_id", "_key"])
        out = out.join(source, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
        made.append(F.when(gone, F.lit(b"")).otherwise(F.coalesce("rest", "_text")).alias("kept"))
    return out.select(*made)
