import heapq
import math
import re
from collections import Counter

import numpy as np
import pytest

from larder.llm import lexical
from larder.llm.queries import ORACLES, QUERIES

from .oracle import same

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[-1], -x[0]) for r, x in enumerate(heapq.nsmallest(k, scores))]
    return sorted(out, key=str)


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << b, 50) for b in range(1, 62)] + [[0, 127, 128, 16383, 16384]])
    data, size = lexical.varbytes(values)
    assert size.sum() == len(data) and (lexical.values_of(data) == values).all()
    assert len(lexical.values_of(lexical.varbytes(values[:0])[0])) == 0


@pytest.mark.parametrize("n", [1, 2, 9, 3000])
def test_merge(n):
    rng = np.random.default_rng(n)
    lists, total = [], Counter()
    for _ in range(n):
        at = np.unique(rng.integers(0, 60, rng.integers(0, 30)))
        score = rng.integers(1, 4, len(at))
        total.update(dict(zip(at.tolist(), score.tolist(), strict=True)))
        lists.append((at << lexical.SCORE_BITS) | score)
    want = sorted(((s, p) for p, s in total.items()), key=lambda x: (-x[0], x[1]))
    for k in (1, 5, 100):
        assert lexical.merge(lists, k) == want[:k]
    assert lexical.merge([], 3) == []


def test_terms():
    for text in ["", None, "A b_C-d9É\x7fü x　y", "".join(map(chr, range(0x300)))]:
        assert [w.decode() for w in lexical.terms(text)] == words(text)


def test_sql(spark):
    assert same(spark, QUERIES["op12_lexical_search"], ORACLES["op12_lexical_search"], "/root/testdata/sf0.01") > 100


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 7, "item_group": 2}, {"block_terms": 20, "item_group": 1}])
@pytest.mark.parametrize("sent", [True, False])
def test_odd_rows(spark, blocks, sent, monkeypatch):
    if not sent:
        monkeypatch.setattr(lexical, "BROADCAST", -1)
    docs = [(k, ["red fish blue fish", "Red dog", "old cat, new cat; red", "one"][k % 4]) for k in range(40)]
    docs += [(3, "red fish blue fish"), (None, "red dog"), (None, None), (-5, "red dog"), (1 << 61, "blue fish"), (77, None), (78, ""), (79, "..."), (80, "long fish " * 20000), (81, "é É 漢字")]
    items = [(1, "Red FISH red"), (1, "cat"), (2, None), (3, ""), (4, "none such"), (None, "dog dog 漢字"), (5, "é one"), (6, " ".join(f"w{k}" for k in range(3000)) + " cat")]
    df = spark.createDataFrame([(*d, 1, b"") for d in docs], "doc_id long, text string, block int, data binary")
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string")
    got = sorted((tuple(r) for r in lexical.search(df, asked, k=6, **blocks).collect()), key=str)
    assert got == brute(docs, items, 6)
    assert lexical.search(df.limit(0), asked).collect() == [] and lexical.search(df, asked.limit(0)).collect() == []
    assert lexical.search(df.where("doc_id in (77, 78)"), asked).collect() == []


def test_index_is_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lexical.index(docs, block_terms=4_000).collect()
    want, got = Counter(), Counter()
    for d in docs.collect():
        want.update((d.doc_id, t, n) for t, n in Counter(words(d.text)).items())
    held = {r.block: lexical.documents_of(r.data)[0] for r in rows if r.term == ""}
    assert len(held) > 4 and all(x == sorted(x) for x in held.values())
    for r in rows:
        if r.term:
            values = lexical.values_of(np.frombuffer(r.data, np.uint8))
            at = np.cumsum(values[::2])
            assert r.n_docs == len(at)
            got.update((held[r.block][p], r.term, int(n)) for p, n in zip(at, values[1::2], strict=True))
    assert got == want
