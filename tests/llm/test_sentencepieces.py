import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from larder.llm import sentencepieces
from larder.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return sentencepieces.Pieces(PATH)


def framed(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def test_random_texts(coder):
    rng = random.Random(7)
    names = list(coder.ids)
    texts = ["", " ", "  ", "▁", "▁▁ ▁", "\x00", "²." * 5, "x" * 5000, "ab" * 3000, "漢字かな交じり文" * 200, "<s></s><unk><0x41>", "﻿a​\U0010ffff"]
    for _ in range(4000):
        texts.append("".join(rng.choice(names) for _ in range(rng.randint(1, 9))))
        texts.append("".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x3000), rng.randint(0x1F600, 0x1F640), rng.randint(0x4E00, 0x6000), 0x2581, 32, 10])) for _ in range(rng.randint(0, 40))))
        texts.append("".join(rng.choice("  aetnrsxle\n1.,-²”") for _ in range(rng.randint(0, 60))))
    for text, ids in zip(texts, coder.framed(texts), strict=True):
        assert ids.tolist() == framed(text), repr(text)
        assert coder.decode(ids).decode() == LIBRARY.decode(ids.tolist()), repr(text)


def test_random_ids(coder):
    rng = random.Random(8)
    for _ in range(6000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(120, 258), 0, 1, 2, 259, 29871]) for _ in range(rng.randint(0, 12))]
        assert coder.decode(np.array(ids, np.int64)).decode() == LIBRARY.decode(ids), ids
    with pytest.raises(ValueError):
        coder.decode(np.array([32000]))


def test_table_is_merging(coder):
    """The prefix table against merging by definition, on parts of every kind and with the caches emptied."""
    rng = random.Random(9)
    coder.clear()
    coder.pairs.clear()
    for _ in range(3000):
        part = "▁" * rng.randint(0, 3) + "".join(rng.choice("aeintrsdlouàéñ.,:") for _ in range(rng.randint(1, 14)))
        want = [coder.ids[x] for x in coder.merged(part)]
        assert coder.solve(part) == want, part


def test_kept_parts_start_anew(coder, monkeypatch):
    monkeypatch.setattr(coder, "PARTS", 10)
    monkeypatch.setattr(coder, "PAIRS", 5)
    for n in range(30):
        text = f"some words{n} of text number {n} " * 3 + "y" * 100
        assert coder.framed([text, text])[1].tolist() == framed(text)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        ids = framed(d.text)
        want.append((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in QUERIES["op11_sentencepiece"](spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a  b\n"), (3, "a  b\n"), (None, "c"), (4, "word " * 40000), (5, "z" * 100000), (6, "\U0001f600" * 300)]
    df = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, value int, ids binary")
    key = lambda r: str(r)
    both = sentencepieces.round_trip(df, PATH).collect()
    want = [(i, framed(t)) for i, t in docs]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in both), key=key) == sorted(want, key=key)
    assert sorted(((r.doc_id, r.decoded) for r in both), key=key) == sorted(((i, t or "") for i, t in docs), key=key)
    coded = sentencepieces.encode(df, PATH)
    assert sorted(map(key, sentencepieces.decode(coded, PATH).collect())) == sorted(map(key, [type(both[0])(doc_id=i, text=t or "") for i, t in docs]))
    assert sentencepieces.decode(coded.selectExpr("doc_id", "cast(null as binary) as ids"), PATH).where("text <> ''").count() == 0
    assert sentencepieces.round_trip(df.limit(0), PATH).collect() == []
