import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import sadedup
from larder.llm.queries import ORACLES, QUERIES

from .oracle import same


def brute(rows, length=400):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        seen.update(r[a : a + length] for a in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                gone[a] += 1
                if a + length < len(gone):
                    gone[a + length] -= 1
        cover = np.cumsum(gone[:-1]) > 0
        runs = int((np.diff(np.concatenate([[False], cover]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~cover])
        out.append((i, len(r), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert sum(0 < r[2] < r[1] for r in want) > 3
    assert got(sadedup.remove_repeats(docs)) == want


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(sadedup, "HOT", 3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    core, tail = word(330), word(800)
    rows = [(10000 + k, word(60) + core + word(200)) for k in range(30)] + [(20000 + k, word(k) + tail) for k in range(30)] + [(30000 + k, tail[k : 500 + k]) for k in range(0, 90, 7)]
    rows += [tuple(r) for r in docs.collect()]
    assert got(sadedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("hot", [1, 4096])
def test_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(sadedup, "HOT", hot)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    a, b, c = word(700), word(399), word(1500)
    rows = [
        (1, None), (2, ""), (3, a), (4, a), (5, "x" + a[100:600] + "y"), (6, b), (7, b), (8, word(50) + b + "q"), (9, c + word(30) + c), (10, "z" * 5000),
        (11, "ab" * 1000 + word(500)), (12, c[:900] + word(10) + a[200:]), (None, c[300:1200]), (14, "short"), (14, "short"), (15, word(2000)), (15, word(2000)),
        (16, word(20) + "ab" * 210), (17, "line one.\n" * 300), (18, "line one.\n" * 41), (19, word(1 << 17) + a[:450] + word(100)), (20, "z" * 401),
    ]
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id long, text string, copies int, key binary")
    want = brute(rows)
    out = sadedup.remove_repeats(df, with_kept=True)
    assert got(out.drop("kept")) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())
    assert sadedup.remove_repeats(df.limit(0)).collect() == []


def test_merge_equals_sorting_all():
    rng = np.random.default_rng(7)
    strings = [rng.integers(1, 4, rng.integers(0, 12)).tolist() for _ in range(60)]
    shards = [strings[:20], strings[20:35], strings[35:]]
    parts = []
    for s in shards:
        parts.append(sadedup.transform(np.array([x for y in s for x in y], np.int64), np.cumsum([len(y) for y in s])))
    for depth in (1, 2, 3, 5):
        source, interval = sadedup.merge([t for _, t in parts], depth)
        suffixes = []
        for n, s in enumerate(shards):
            flat = [(y, k) for y in s for k in range(len(y) + 1)]
            order = parts[n][0]
            suffixes.append([flat[o][0][flat[o][1] : flat[o][1] + depth] for o in order])
        at = [0, 0, 0]
        found = defaultdict(list)
        merged = []
        for s, i in zip(source, interval, strict=True):
            found[i].append(suffixes[s][at[s]])
            merged.append(suffixes[s][at[s]])
            at[s] += 1
        assert merged == sorted(merged)
        want = Counter(tuple(x) for y in suffixes for x in y if len(x) == depth)
        assert Counter({tuple(v[0]): len(v) for v in found.values() if len(v) > 1}) == Counter({k: n for k, n in want.items() if n > 1})


def test_anchor_in_every_window():
    rng = np.random.default_rng(9)
    for text in (bytes(rng.integers(97, 105, 3000).astype(np.uint8)), b"ab" * 900, b"line one. " * 200, b"a" * 2000 + bytes(rng.integers(97, 105, 900).astype(np.uint8)) + b"a" * 2000):
        at, h = sadedup.anchors(text)
        grams = sadedup.Spans(np.frombuffer(text, np.uint8)).rolling(sadedup.GRAM)
        assert (grams[at] == h).all()
        kept = set(at.tolist())
        for a in range(len(text) - 399):
            window = grams[a : a + 400 - sadedup.GRAM + 1]
            assert any(a + k in kept for k in np.nonzero(window == window.min())[0]), a


def test_intervals():
    rng = np.random.default_rng(12)
    base = [bytes(rng.integers(97, 101, 900).astype(np.uint8)) for _ in range(4)]
    segments = [base[k % 4][rng.integers(0, 300) : rng.integers(560, 900)] for k in range(60)] + [b"ab" * 300, b"ab" * 290 + b"c", b"z" * 500, bytes(range(256)) * 2]
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in segments])])
    raw = b"\0".join([*segments, b""])
    seen = defaultdict(list)
    for k, x in enumerate(segments):
        for a in range(len(x) - 399):
            seen[x[a : a + 400]].append(int(starts[k]) + a)
    want = sorted(sorted(v) for v in seen.values() if len(v) > 1)
    found = defaultdict(list)
    for at, n in zip(*(x.tolist() for x in sadedup.intervals(raw, starts, 400)), strict=True):
        found[n].append(at)
    assert sorted(sorted(v) for v in found.values()) == want


def test_sql(spark):
    assert same(spark, QUERIES["op8_suffix_dedup"], ORACLES["op8_suffix_dedup"]) == 200
