"""Ranked lexical search over an inverted index in blocks of documents.

A block holds a bounded number of documents: for each term the block's postings, ordered by doc_id and compressed, and one row with the documents' ids and
lengths. Blocks are made where their documents are read, so no text is shuffled. A search reads the postings of its terms only; a task has
one block and a group of items, and answers each item document by document: a heap merges the terms' postings in order of doc_id, a
second heap holds the best documents so far. The blocks' best are merged by rank.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, width
from .words import spread_join

#: Bytes to terms: A-Z lower-cased, all ASCII but letters and digits a space. Bytes beyond ASCII are parts of terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bits of a score in a merged posting; a place in a block has 16 more.
SCORE_BITS, BLOCK_DOCS = 37, 1 << 16
#: Bytes of an index' terms and items that are sent to all tasks; more are joined by shuffle.
BROADCAST = 64 << 20


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def varbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in seven bits a byte, low bits first, the last byte of each with its high bit set; and each value's number of bytes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> np.uint64(7 * k) > 0
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[ends[has] - size[has] + k] = values[has] >> np.uint64(7 * k) & np.uint64(127)
    out[ends - 1] |= 128
    return out, size


def values_of(data: np.ndarray) -> np.ndarray:
    """What ``varbytes`` wrote."""
    last = np.nonzero(data & 128)[0]
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    parts = (data & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


class _Block:
    """Documents' terms as numbers, until they are written as postings."""

    def __init__(self):
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, i: int | None, text: str | None) -> None:
        found = terms(text)
        self.ids.append(i)
        self.lengths.append(len(found))
        self.parts.append(np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found)))
        self.size += len(found)

    def table(self, name: str) -> pa.RecordBatch:
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~known))  # without an id: last
        slot = np.empty(len(ids), np.int64)
        slot[order] = np.arange(len(ids))
        lengths = np.array(self.lengths, np.int64)
        key = np.concatenate(self.parts) * BLOCK_DOCS + np.repeat(slot, lengths)
        key, tf = np.unique(key, return_counts=True)
        code, at = key // BLOCK_DOCS, key % BLOCK_DOCS
        first = np.searchsorted(code, np.arange(len(self.codes)))
        gap = np.diff(at, prepend=0)
        gap[first] = at[first]
        data, size = varbytes(np.stack([gap, tf], axis=1).ravel())
        held = np.diff(np.append(first, len(key)))
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(size, 2 * first))]) if len(first) else np.zeros(1, np.int64)
        # The row of the documents: how many have an id, gaps of ids as zigzag numbers, lengths.
        steps = np.diff(ids[order], prepend=0)[: int(known.sum())]
        docs = varbytes(np.concatenate([[known.sum()], (steps.view(np.uint64) << np.uint64(1)) ^ (steps >> 63).view(np.uint64), lengths[order]]).astype(np.uint64))[0]
        rows = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        n = len(first) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * n), pa.concat_arrays([pa.array([""]), pa.array(list(self.codes), pa.binary()).cast(pa.string())]), pa.array(np.append((lengths > 0).sum(), held), pa.int64()),
                pa.array(np.append(lengths.sum(), np.zeros(n - 1, np.int64)), pa.int64()), pa.concat_arrays([pa.array([docs.tobytes()], pa.binary()), rows]),
            ],
            ["block", "term", "n_docs", "n_terms", "data"],
        )


def documents_of(data: bytes) -> tuple[list[int | None], np.ndarray]:
    """Ids and lengths of a block's documents, by place."""
    values = values_of(np.frombuffer(data, np.uint8))
    known, rest = int(values[0]), values[1:].view(np.uint64)
    n = len(rest) - known
    steps = (rest[:known] >> np.uint64(1)).view(np.int64) ^ -(rest[:known] & np.uint64(1)).view(np.int64)
    return [*np.cumsum(steps).tolist(), *[None] * (n - known)], values[1 + known :]


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 32_768, block_terms: int = 4_000_000) -> DataFrame:
    """(block, term, n_docs, n_terms, data): the staged index of all documents.

    Term "" has the block's documents: how many have a term, their terms in all, ids and lengths. ``n_docs`` of any other row is the number of the block's documents with the term.
    A block is full at ``block_docs`` documents or ``block_terms`` terms; one longer document is a block of its own.
    """
    if not 0 < block_docs <= BLOCK_DOCS:
        raise ValueError(f"a block holds 1 to {BLOCK_DOCS} documents")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        # An executor that is lost has its blocks made again, under other names; only rows of tasks that ended well are in the staged table.
        block = _Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    block.add(i, text)
                    if len(block.ids) >= block_docs or block.size >= block_terms:
                        yield block.table(uuid.uuid4().hex)
                        block = _Block()
        if block.ids:
            yield block.table(uuid.uuid4().hex)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(work, "block string, term string, n_docs long, n_terms long, data binary"), "index")


def merge(lists: list[np.ndarray], k: int) -> list[tuple[int, int]]:
    """The k best (score, place), best first, equal scores by place. ``lists``: a term's ``place << SCORE_BITS | score`` each, by place.

    The heap has the next posting of every list; scores of one place follow each other there. The bounded heap keeps (score, -place).
    """
    bits = max(1, (len(lists) - 1).bit_length())
    room = int(max((x[-1] for x in lists if len(x)), default=0)).bit_length() + bits < 63
    nexts = [iter(((x << bits) | n).tolist() if room else [v << bits | n for v in x.tolist()]).__next__ for n, x in enumerate(lists) if len(x)]
    which = [n for n, x in enumerate(lists) if len(x)]
    step = dict(zip(which, nexts, strict=True))
    heap = [f() for f in nexts]
    heapq.heapify(heap)
    mask, low, shift = (1 << bits) - 1, (1 << SCORE_BITS) - 1, SCORE_BITS + bits
    best: list[tuple[int, int]] = []
    place, score, worst = -1, 0, 0
    replace, pop = heapq.heapreplace, heapq.heappop
    while heap:
        top = heap[0]
        here = top >> shift
        if here != place:
            if score > worst:
                if len(best) < k:
                    heapq.heappush(best, (score, -place))
                else:
                    replace(best, (score, -place))
                worst = best[0][0] if len(best) == k else 0
            place, score = here, 0
        score += top >> bits & low
        try:
            replace(heap, step[top & mask]())
        except StopIteration:
            pop(heap)
    if score > worst:
        if len(best) < k:
            heapq.heappush(best, (score, -place))
        else:
            replace(best, (score, -place))
    return [(s, -p) for s, p in sorted(best, reverse=True)]


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10, item_group: int = 1024, **blocks: int,
) -> DataFrame:
    """(item, rank, id, score): each item's k documents of largest score above 0, equal scores by ascending id.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), a document's score the sum over the item's distinct terms of w (10^9 tf div (1000 tf + 8 m)), m = 10 + 90 n N div L: N documents with a term, L terms
    of all, n of the document, tf of the term in it. Null texts have no terms; rows of equal id or text are documents of their own; documents without an id come
    after those of equal score. Items without terms, and terms that no document has, find nothing; items of equal id are answered one by one, their ranks each from 1. Empty tables give no rows.
    ``item_group``: items that meet a block together; ``blocks``: block_docs and block_terms of ``index``.
    """
    spark = docs.sparkSession
    made = index(docs, id_col, text_col, **blocks)
    n_docs, n_terms, n_blocks = (x or 0 for x in made.where("term = ''").agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first())
    kind = items.schema[item_col].dataType.simpleString()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(n, t.decode()) for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.string())], ["item", "term"])

    listed = stage(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("name"), F.col(item_text).cast("string").alias("text")), "items")
    groups = max(1, -(-listed.count() // item_group))
    pairs = listed.select("item", "text").mapInArrow(asked, "item long, term string").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    wanted = stage(pairs.groupBy("part", "term").agg(F.collect_list("item").alias("items")), "wanted")
    size = wanted.agg(F.sum(F.octet_length("term") + 8 * F.size("items") + 64)).first()[0] or 0

    def of_blocks(rows: DataFrame, few: DataFrame) -> DataFrame:
        """Rows of the index with those of their terms: the few are sent to all tasks up to ``BROADCAST`` bytes; beyond, a common term's blocks are dealt to many tasks."""
        return rows.join(F.broadcast(few), "term") if size <= BROADCAST else spread_join(rows, few, ["term"], ["block"], max(16, width(spark)))

    df = of_blocks(made.where("term <> ''").select("block", "term", "n_docs"), wanted.select("term").distinct()).groupBy("term").agg(F.sum("n_docs").alias("df"))
    wanted = stage(wanted.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), "wanted")
    used = of_blocks(made.where("term <> ''").select("block", "term", "data"), wanted)
    every = made.where("term = ''").select("block", "term", "data", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.array().cast("array<bigint>").alias("items"), F.lit(0).cast("long").alias("df"))
    used = used.unionByName(every)

    def answer(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("term", "data", "df", "items")), strict=True))
        ids, lengths = next(documents_of(data) for term, data, _, _ in rows if term == "")
        m = 10 + (90 * n_docs * lengths) // n_terms if n_terms else lengths
        of_item: dict[int, list[np.ndarray]] = defaultdict(list)
        for term, data, df, held in rows:
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            if term and weight > 0:
                values = values_of(np.frombuffer(data, np.uint8))
                at, tf = np.cumsum(values[::2]), values[1::2]
                score = (at << SCORE_BITS) | (weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at])))
                for item in held:
                    of_item[item].append(score)
        out = [(item, ids[at], score) for item, lists in of_item.items() for score, at in merge(lists, k)]
        return pa.table({"item": pa.array([x[0] for x in out], pa.int64()), "id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

    # Work follows postings and items, not bytes, so tasks aren't put together by bytes.
    dealt = used.repartition(min(max(1, n_blocks * groups), 4096), "block", "part")
    found = dealt.groupBy("block", "part").applyInArrow(answer, "item long, id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(listed.select("item", "name"), "item").select(F.col("name").cast(kind).alias(item_col), "rank", F.col("id").alias(id_col), "score")
