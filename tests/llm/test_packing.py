import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from larder.llm import packing
from larder.llm.queries import PACKING

PATH = public_tokenizers.path("word_bpe_49k.json")


CODER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*CODER.encode(text or "", add_special_tokens=False).ids, 0]


def whole(rows, docs, limit=2048):
    at, used = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.doc_id].append(r)
        used[r.sequence_id].append(r)
    for s in used.values():
        end = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= limit
    want = sorted((i, n, a, len(ids[a : a + limit]), zlib.crc32(np.array(ids[a : a + limit], "<u4").tobytes())) for i, t in docs for ids in [ids_of(t)] for n, a in enumerate(range(0, len(ids), limit)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(used)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs, PATH).collect()
    n = whole(rows, [tuple(r) for r in docs.collect()])
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs, PATH, limit=512, max_docs=3, max_attention=150_000, weights=(1, 0.5, 0.5), rule=rule, group=50, with_ids=True).collect()
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append(r.length)
        assert len(r.ids) == r.length
    assert all(sum(s) <= 512 and len(s) <= 3 and sum(x * x for x in s) <= 150_000 for s in used.values())
    assert len(used) < len(rows)


def plain_best_fit(sizes, capacity, weights, rule):
    """Vector best-fit decreasing written plainly: every bin stays open and is tried for every item."""
    bins, out = [], {}
    share = [sum(x / c for x, c in zip(s, capacity, strict=True)) for s in sizes]
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k][0], -share[k], k)):
        best = None
        for b, free in enumerate(bins):
            if all(x <= f for x, f in zip(sizes[k], free, strict=True)):
                after = [(f - x) / c for x, f, c in zip(sizes[k], free, capacity, strict=True)]
                before = [f / c for f, c in zip(free, capacity, strict=True)]
                if rule == "norm":
                    score = -sum(w * a * a for w, a in zip(weights, after, strict=True))
                else:
                    score = sum(w * f * x / c for w, f, x, c in zip(weights, before, sizes[k], capacity, strict=True))
                if best is None or score > best[0] + 1e-12:
                    best = (score, b)
        if best is None:
            bins.append(list(capacity))
            best = (0, len(bins) - 1)
        bins[best[1]] = [f - x for f, x in zip(bins[best[1]], sizes[k], strict=True)]
        out[k] = best[1]
    return out, bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_plain_vector_best_fit(rule, seed):
    rng = np.random.default_rng(seed)
    size = np.concatenate([rng.integers(1, 40, 150), rng.integers(40, 2049, 150)])
    dims = np.stack([size, np.ones_like(size), size * size], axis=1)
    capacity, weights = np.array([2048, 3, 2048 * 2048]), np.array([1.0, 0.7, 0.4])
    got = packing.best_fit(dims, capacity, weights, rule)
    want, bins = plain_best_fit(dims.tolist(), capacity.tolist(), weights.tolist(), rule)
    # Equally good bins may be named differently: what each bin holds in all is compared.
    held = sorted(tuple(dims[got == b].sum(axis=0)) for b in range(got.max() + 1))
    assert held == sorted(tuple(c - f for c, f in zip(capacity.tolist(), b, strict=True)) for b in bins)
    assert max(np.bincount(got)) == 3


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "ab <|endoftext|> It's don't  é  x　y\n\t'LL 12345 !!!??"), (4, "word " * 50000), (5, "x" * 3000), (6, "İΣ ΣΣ ﬁ")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row int, piece int")
    whole(packing.pack(df, PATH).collect(), docs)
    assert packing.pack(df.limit(0), PATH).collect() == []
    twice = packing.pack(df.unionAll(df), PATH).collect()
    assert len(twice) == 2 * len(packing.pack(df, PATH).collect())


def test_every_white_space(spark):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    texts = [f"ab{x}cd" for x in signs] + [f"{x}ab {x} cd{x}" for x in signs] + ["\x1c", "\x1d\x1e \x1f", "one\x1ctwo\n\x1dthree\u3000four\x1f", "".join(signs)]
    texts += [f"ab{chr(c)}cd {chr(c)} e{chr(c)}" for c in range(256)] + [chr(c) for c in range(256)]
    docs = [*enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole(packing.pack(df, PATH).collect(), docs)


@pytest.mark.parametrize("words", [1, 3, 10, 30])
def test_short_texts_take_no_more_than_their_tokens(spark, words):
    """One group leaves one sequence partly filled, whatever the number of documents in it."""
    docs = [(k, " ".join(["the"] * words)) for k in range(9000)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, **PACKING).collect()
    groups = len({r.sequence_id >> 32 for r in rows})
    assert groups == 2 and whole(rows, docs) <= -(-9000 * (words + 1) // 2048) + groups


def test_tiny_and_large_texts_together(spark):
    """Most documents are tiny and fill what large ones leave; a bound on documents would cost sequences here."""
    docs = [(k, " ".join(["the"] * (2040 if k % 20 == 0 else 1))) for k in range(6000)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, **PACKING).collect()
    assert whole(rows, docs) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_common_words_are_learned_once(monkeypatch):
    """Rare words go when too many are kept; common ones stay, and every text's ids are the tokenizer's."""
    monkeypatch.setattr(packing._Words, "LIMIT", 500)
    coder, learned = packing._Words(PATH), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda new: learned.extend(new) or learn(new))
    rng = np.random.default_rng(7)
    rare = lambda: "".join(rng.choice([*"abcdefgh"], 9))
    for _ in range(40):
        texts = [" ".join([f"common{chr(97 + k % 26)}{chr(97 + k // 26)}," for k in range(100)] + [rare() for _ in range(20)]) for _ in range(5)] + [None, "", " \n", "a<b 'tis\x1cso"]
        for t, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
            assert [*ids.tolist(), 0] == ids_of(t)
    assert len(coder.words.number) <= 700
    assert sum(w.startswith("common") for w in learned) == 100
