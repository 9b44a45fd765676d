"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are hashed words, stems (leading bytes of longer words), pairs of neighbours and pairs with one word between, present or not. The learner
keeps a rate per coordinate and an L1 penalty, so almost all weights are exactly zero and those left are a small table that
is sent to every task. Training runs in one task on a bounded sample of the labelled rows (the method is sequential); with more shards, each has a learner of its own
and their weights are averaged, which costs accuracy at this sample size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .bytehash import Spans, mix
from .staging import stage

BITS = 20
STEMS = (4, 5, 6, 7, 8)
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), with repeats, of a batch of texts."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    is_word = np.concatenate([[False], _WORD[data], [False]])
    turn = np.diff(is_word.view(np.int8))
    start, end = np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]
    part = Spans(data).at
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, start, side="right")
    word = part(start, end)
    out = [(doc, word)]
    for n in STEMS:
        long = end - start > n
        out.append((doc[long], part(start[long], start[long] + n) + np.uint64(n)))
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        out.append((doc[gap:][same], mix(word[:-gap][same] * np.uint64(3) + np.uint64(gap)) + word[gap:][same]))
    docs, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    return docs, (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


class Learner:
    """FTRL-proximal for logistic loss on sets of present features; the last coordinate is the bias and isn't penalised."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, present: np.ndarray, label: int) -> None:
        at = np.append(present, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: DataFrame, shards: int = 1, passes: int = 8, bits: int = BITS, **rates: float) -> dict[int, float]:
    """Nonzero weights by feature, the bias at 2 ** bits. ``rows``: (key, text, label 0 or 1), a bounded number of them; ``key`` orders a shard."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.of("toxicity")
        for batch in batches:
            sets = []
            for a in range(0, batch.num_rows, 64):
                part = [t or "" for t in batch.column(1).slice(a, 64).to_pylist()]
                docs, found = features(part, bits)
                both = np.unique((docs << bits) | found)
                cut = np.searchsorted(both >> bits, np.arange(len(part) + 1))
                sets += [_packed(both[x:y] & ((1 << bits) - 1)) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], ["key", "label", "present"])

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("present", "ascending")])
        learner, sets = Learner(bits, **rates), table.column("present")
        for _ in range(passes):
            for row, y in zip(sets, table.column("label").to_pylist(), strict=True):
                learner.learn(_unpacked(row.as_buffer()), y)
        w = learner.weights(slice(None))
        at = np.nonzero(w)[0]
        return pa.table({"feature": at, "weight": w[at]})

    kind = rows.schema["key"].dataType.simpleString()
    seen = rows.select("key", "text", "label").mapInArrow(present, f"key {kind}, label int, present binary")
    found = seen.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(work, "feature long, weight double")
    total = found.groupBy("feature").agg(F.sum("weight").alias("w")).collect()  # 2 ** bits + 1 rows at most
    return {r.feature: r.w / shards for r in total}


def _packed(features: np.ndarray) -> bytes:
    """Rising numbers as the gaps between them, in two bytes each where all fit, else in four."""
    gaps = np.diff(features, prepend=0)
    wide = len(gaps) > 0 and int(gaps.max()) > 0xFFFF
    return bytes([wide]) + gaps.astype(np.uint32 if wide else np.uint16).tobytes()


def _unpacked(data: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32 if data[0] else np.uint16, offset=1), dtype=np.int64)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(key, text, label) of about ``max_rows`` labelled rows, by hash of the id, or all if there are no more. Null ids, and labels other than 0 and 1, are left out."""
    own = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    own = own.groupBy("key").agg(F.max("label").alias("label"))
    own = stage(own, "labels")
    grain = 1 << 20
    share = math.ceil(grain * min(1.0, max_rows / max(1, own.count())))
    own = own.where(F.pmod(F.xxhash64("key"), F.lit(grain)) < share)
    # At most about max_rows small rows.
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(own), "key")


def score(df: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, to: str = "score") -> DataFrame:
    """(id, ``to``): the probability of label 1 for each row's whole text. A null text is scored as an empty one."""
    kind = df.schema[id_col].dataType.simpleString()
    of = _scorer(df, weights, bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.of("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1)))], ["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, score double").toDF(id_col, to)


def _scorer(df: DataFrame, weights: dict[int, float], bits: int) -> Callable[[pa.Array], np.ndarray]:
    """A function from a batch's texts to their scores, for tasks."""
    at = np.array(sorted(weights), np.int64)
    sent = df.sparkSession.sparkContext.broadcast((at, np.array([weights[k] for k in at.tolist()])))

    def of(texts: pa.Array) -> np.ndarray:
        at, value = sent.value
        table = np.zeros((1 << bits) + 1)
        table[at] = value
        out = [np.zeros(0)]
        for a in range(0, len(texts), 256):
            part = texts.slice(a, 256)
            docs, found = features([t or "" for t in part.to_pylist()], bits)
            hit = table[found] != 0
            both = np.unique((docs[hit] << bits) | found[hit])
            total = table[-1] + np.bincount(both >> bits, table[both & ((1 << bits) - 1)], len(part))
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return np.concatenate(out)

    return of


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that no label is learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, threshold: float = 0.5, **how
) -> DataFrame:
    """(id, held_out, score, predicted): one row a row of ``docs``; trained on labelled rows that aren't held out.

    ``max_rows`` bounds the labelled rows that are learnt from (a sample by hash of the id beyond it); every row is scored, by its text alone. Null and empty texts get the
    score of the bias. Rows of equal id are scored each by their text. Without usable labels all scores are 0.5.
    """
    rows = sample(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col, text_col, label_col, max_rows)
    weights = fit(rows, **how) or {1 << BITS: 0.0}
    out = score(docs, weights, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay, whatever their names.

    One pass: rows are judged where they are read, none is shuffled. Null and empty texts get the score of the bias, as in ``toxicity``; repeated rows stay or go together; an empty table gives no rows. Without
    usable labels all scores are 0.5, and as nothing is known then, all rows stay.
    """
    learnt = sample(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), id_col, text_col, how.pop("label_col", "toxic"), how.pop("max_rows", 20_000))
    weights = fit(learnt, **how)
    if not weights:
        return docs
    of = _scorer(docs, weights, BITS)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.of("toxicity")
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(at)) < threshold))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # Arrow functions don't take every name
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
