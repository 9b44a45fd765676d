"""Vector best-fit packing of tokenised documents into sequences.

Documents are tokenised once; only what a bin needs to know of a piece (its place and length, not its ids) is staged and shuffled. Pieces
are dealt by hash to groups of a set size, each packed in one task: largest first, every piece goes to the open bin that fits it in
all of three capacities (tokens, documents, attention cost) and scores best by weighted dot product or residual norm. A group leaves
about one bin partly filled, so the loss is that of one bin in some thousands at any table size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Iterator
from itertools import chain, compress, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .staging import stage

# Words of these letters, digits and signs fall into the pieces below whatever stands beside them: the vocabulary's own rule never joins letters
# with digits or signs, but for an apostrophe, and its special tokens hold "<". Others are encoded whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_SIGNS = r"!-&(-/:;=-@\[-`{-~"
_SIMPLE = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+")
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+|\n")
_WORD_END = "</w>"

#: Bytes of texts that are encoded together, and at most one text more.
AT_ONCE = 2 << 20

# Python counts U+001C to U+001F as white space; the tokenizer doesn't drop them.
_SEPARATOR = "[\x1c-\x1f]"
_WORD = re.compile("[\\S\x1c-\x1f]+")


def _split(texts: pa.Array) -> pa.ListArray:
    """Each text's words, parted at the white space that the tokenizer drops, and maybe empty ones; a null text has none that isn't empty."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, _SEPARATOR)).as_py():
        return pa.array(map(_WORD.findall, texts.to_pylist()), pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


class _Lists:
    """Numbered lists of ids, or of other numbers, in one growing array."""

    def __init__(self, kind: type = np.uint32):
        self.flat, self.start, self.size = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.size) < self.n + len(sizes):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        here = slice(self.n, self.n + len(sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[here], self.size[here] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(sizes), self.used + len(ids)

    def join(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists, one after another, and where each ends."""
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[which] - ends + sizes, sizes) + np.arange(total)], ends


class _Known:
    """The ids of texts met before, numbered; number 0 is ``empty``, which has none. What is kept only saves work."""

    def __init__(self, empty: str):
        self.number, self.lists, self.met = {empty: 0}, _Lists(), np.zeros(1 << 16, np.int32)
        self.lists.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def add(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(texts, range(len(self.number), len(self.number) + len(texts)), strict=True))
        self.lists.add(ids, sizes)
        if len(self.met) < len(self.lists.size):
            self.met = np.concatenate([self.met, np.zeros(len(self.lists.size) - len(self.met), np.int32)])

    def codes(self, texts: Collection[str]) -> np.ndarray:
        """The texts' numbers, -1 for others."""
        return np.fromiter(map(self.number.get, texts, repeat(-1)), np.int64, len(texts))

    def trim(self, limit: int) -> None:
        """Beyond ``limit`` texts, those stay that were met again since they came or last stayed, the most frequent ones and half of ``limit`` at most."""
        if (n := len(self.number)) <= limit:
            return
        met = self.met[:n]
        keep = met > max(1, np.partition(met, n - 1 - limit // 2)[n - 1 - limit // 2])
        keep[0] = True
        ids, ends = self.lists.join(np.nonzero(keep)[0])
        self.number = {text: k for k, text in enumerate(compress(self.number, keep))}
        self.lists = _Lists()
        self.lists.add(ids, np.diff(ends, prepend=0))
        self.met = np.zeros(len(self.lists.size), np.int32)
        self.met[: len(self.number)] = 1


class _Words:
    """Token ids of white-space separated words; the vocabulary used here drops white space, so a text's ids are its words' in order."""

    LIMIT = 450_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.pieces, self.words = _Known("\n"), _Known("")

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = list(filter(_SIMPLE.fullmatch, new))
        found = _PIECE.findall("\n".join([*plain, ""]).lower())
        self.pieces.trim(self.LIMIT)
        if fresh := list(set(found).difference(self.pieces.number)):
            # A piece is one word of the vocabulary's rule, so its last id, and no other, has the mark of a word's end.
            lists = self._encoded([" ".join(fresh[k : k + 1000]) for k in range(0, len(fresh), 1000)])
            ids = np.concatenate([np.array(x, np.uint32) for x in lists])
            self.pieces.add(fresh, ids, np.diff(np.nonzero(self.ends[ids])[0], prepend=-1))
        codes = self.pieces.codes(found)
        self.pieces.met[codes] += 1
        ids, ends = self.pieces.lists.join(codes)
        self.words.add(plain, ids, np.diff(ends[codes == 0], prepend=0))
        odd = list(set(new).difference(plain)) if len(plain) < len(new) else []
        if odd:
            lists = self._encoded(odd)
            self.words.add(odd, np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Each distinct word is looked up once."""
        self.words.trim(self.LIMIT)
        split = _split(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        codes = self.words.codes(words)
        new = np.nonzero(codes < 0)[0]
        if len(new):
            self._learn(words[new].tolist())
            codes[new] = self.words.codes(words[new])
        self.words.met[codes] += 1
        ids, ends = self.words.lists.join(codes[coded.indices.to_numpy()])
        last = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        for a, b in zip([0, *last], last, strict=False):
            yield ids[a:b]


def _tokenizer(path: str) -> _Words:
    held = caches.of("packing")
    if path not in held:
        held[path] = _Words(path)
    return held[path]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32): each text's ids and the end id, cut every ``limit`` ids; a null text has the end id only.

    ``tokenizer``: path of a tokenizer file that drops white space, present on every executor. ``row`` tells rows of equal ids apart.
    ``with_ids`` adds the ids themselves.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _tokenizer(tokenizer)
        for whole in batches:
            full = np.cumsum(pc.fill_null(pc.binary_length(whole.column(2)), 0).to_numpy().astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.nonzero(np.diff(full))[0] + 1).tolist(), whole.num_rows]
            for at, end in pairwise(cuts):
                batch = whole.slice(at, end - at)
                rows, start, length, crc, piece, kept = [], [], [], [], [], []
                for k, ids in enumerate(coder.encode(batch.column(2))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for n, a in enumerate(range(0, len(ids), limit)):
                        part = ids[a : a + limit]
                        rows.append(k)
                        piece.append(n)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                take = pa.array(rows, pa.int64())
                out = [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """The bin of every item. ``sizes``: items x dimensions, none above ``capacity``; larger items in the first dimension come first.

    ``rule`` "norm" takes the bin whose weighted residual after the item is least, "dot" the one whose residual before it has the largest
    weighted dot product with the item; ties go to the earliest bin.
    """
    scaled = sizes / capacity
    order = np.lexsort([-scaled.sum(axis=1), -sizes[:, 0]])
    bins = np.full(len(sizes), -1, np.int64)
    free = np.empty((1024, sizes.shape[1]), sizes.dtype)
    name = np.empty(1024, np.int64)
    n_open = n_bins = 0
    least = sizes.min(axis=0) if len(sizes) else capacity
    for k in order:
        item = sizes[k]
        fits = np.nonzero((free[:n_open] >= item).all(axis=1))[0]
        if len(fits):
            rest = free[fits]
            if rule == "norm":
                score = -((((rest - item) / capacity) ** 2) * weights).sum(axis=1)
            else:
                score = (rest / capacity * scaled[k] * weights).sum(axis=1)
            at = fits[np.argmax(score)]
        else:
            at = n_open
            if n_open == len(free):
                free, name = np.concatenate([free, free]), np.concatenate([name, name])
            free[at], name[at] = capacity, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        free[at] -= item
        bins[k] = name[at]
        if (free[at] < least).any():  # nothing fits any more; the last bin takes its row
            n_open -= 1
            free[at], name[at] = free[n_open], name[n_open]
    return bins


def pack(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0, max_docs: int | None = None,
    max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", group: int = 8192, with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset [, ids]): every piece with its sequence and its place there.

    Capacities of a sequence: ``limit`` tokens, ``max_docs`` pieces and ``max_attention`` summed squares of lengths (both at what
    ``limit`` implies, if None; below limit squared, longer pieces are cut shorter to fit; at limit squared only a sequence of one piece reaches it, and the residual counts in the score). Rows of equal id or text are packed as separate documents; null texts are empty. An empty
    table gives no rows. ``group``: pieces that one task packs together.
    """
    cut = limit if max_attention is None else min(limit, int(max_attention**0.5))
    capacity = np.array([limit, max_docs or limit, max_attention or limit * limit], np.int64)
    made = stage(pieces(df, tokenizer, id_col, text_col, cut, end_id, with_ids), "pieces")
    groups = max(1, -(-made.count() // group))
    dealt = made.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        size = table.column("length").to_numpy().astype(np.int64)
        bins = best_fit(np.stack([size, np.ones_like(size), size * size], axis=1), capacity, np.array(weights), rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(size[order])
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        base = (ends - size[order])[first]
        offset = np.empty_like(size)
        offset[order] = ends - size[order] - base[np.cumsum(first) - 1]
        sequence = (table.column("group").to_numpy() << 32) + bins
        out = table.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return out

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(work, schema).withColumnRenamed("id", id_col)
