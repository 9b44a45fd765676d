import random
import zlib
from collections import Counter, defaultdict

import pytest

from larder.llm import sharding


def whole(rows, docs, shards=16):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, at = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        at[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in at.values())
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    return [sums[s] for s in range(shards)]


@pytest.mark.parametrize("heads", [4096, 100])
def test_documents(spark, heads):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sums = whole(sharding.shard(docs, heads=heads).collect(), [tuple(r) for r in docs.collect()])
    assert max(sums) - min(sums) <= 0.001 * sum(sums) / 16 + 30


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "hot")] + [(4 + k, "copy " * 50) for k in range(40)] + [(None, "é"), (None, "é"), (90, "x" * 100000), (90, "x" * 100000)]
    df = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, size int, shard int")
    whole(sharding.shard(df).collect(), docs)
    assert sharding.shard(df.limit(0)).collect() == []


def test_differencing():
    sizes = [8, 7, 6, 5, 4]
    law = sharding.differencing(sizes, 2)
    sums = [sum(s for s, p in zip(sizes, law, strict=True) if p == k) for k in range(2)]
    assert sorted(sums) == [14, 16]
    law = sharding.differencing([5] * 32, 16)
    assert Counter(law) == {k: 2 for k in range(16)}


def plain_differencing(sizes, parts):
    """Sums of the parts: the two partial partitions of largest spread are combined, oppositely ordered, until one is left."""
    todo = [[s] + [0] * (parts - 1) for s in sizes]
    while len(todo) > 1:
        todo.sort(key=lambda p: p[0] - p[-1])
        a, b = todo.pop(), todo.pop()
        todo.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return todo[0]


def test_plain_differencing(spark):
    rng = random.Random(3)
    texts = ["x" * n for n in rng.sample(range(1, 20000), 200)]
    docs = [(k, texts[k % 200]) for k in range(260)]  # 60 texts twice, each pair one group
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), shards=16).collect()
    groups = Counter()
    for _, t in docs:
        groups[t] += len(t) + 1
    assert sorted(whole(rows, docs), reverse=True) == plain_differencing(list(groups.values()), 16)
