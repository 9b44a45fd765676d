from collections import Counter

import numpy as np
import pytest
import xxhash

from larder.llm import simhash
from larder.llm.components import connected_components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    votes = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute(rows, radius=4):
    fps = [(i, brute_fp(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        least[find(k)] = min([x for x in (least.get(find(k)), i) if x is not None], default=None)
    return sorted(((i, f"{fp:016x}", least[find(k)]) for k, (i, fp) in enumerate(fps)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(simhash.near_duplicates(docs, block=37)) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "x y z"), (None, "x y z"), (7, "w " * 50000), (8, "é b c d e")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    assert got(simhash.near_duplicates(df)) == brute(rows)
    kept = simhash.keep_one(df, shingle=4)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 7, 8]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_keeps_one_of_similar_texts(spark):
    rng = np.random.default_rng(4)
    rows, groups = [], []
    for g in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((len(rows), " ".join(words)))
        groups.append([len(rows) - 1])
        for _ in range(g % 4):
            near = list(words)
            for k in rng.integers(0, 300, 3):
                near[k] = f"v{rng.integers(1000)}"
            rows.append((len(rows), " ".join(near)))
            groups[-1].append(len(rows) - 1)
        half = words[:150] + [f"u{x}" for x in rng.integers(0, 5000, 150)]
        rows.append((len(rows), " ".join(half)))
        groups.append([len(rows) - 1])
    assert all(jaccard(rows[g[0]][1], rows[i][1]) >= 0.85 for g in groups for i in g)
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [g[0] for g in groups]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one(df).collect() == []


def test_tiles_find_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    near = base[rng.integers(0, 700, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 4)
    want = simhash.spanning(x, y, len(fps))
    u, v = simhash.close_forest(fps, None, 4)
    at = {f: k for k, f in enumerate(fps.tolist())}
    lab = simhash.spanning(np.array([at[a] for a in u.tolist()]), np.array([at[a] for a in v.tolist()]), len(fps))
    assert (lab == want).all()


def planted(rng, n, words, radius, near, hot=0):
    """Random fingerprints, some others at most about ``radius`` bits from one of them, and ``hot`` about the first."""
    base = rng.integers(0, 1 << 64, (n, words), dtype=np.uint64)
    copies = base[np.concatenate([rng.integers(0, n, near), np.zeros(hot, np.int64)])]
    for k, row in enumerate(copies):
        for bit in rng.choice(64 * words, rng.integers(1, radius + 3 if k < near else 4), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    both = np.concatenate([base, copies])
    return both[rng.permutation(np.unique(both[:, 0], return_index=True)[1])]  # the first word names a fingerprint


def forest_groups(fps, found):
    at = {f: k for k, f in enumerate(fps[:, 0].tolist())}
    return simhash.spanning(*(np.array([at[x] for x in side.tolist()], np.int64) for side in found), len(fps))


@pytest.mark.parametrize(("words", "radius", "hot"), [(4, 42, 0), (4, 42, 300), (1, 4, 0), (1, 0, 0), (2, 9, 40), (3, 60, 0)])
@pytest.mark.parametrize("pays", [True, False])
def test_parts_find_every_link(monkeypatch, words, radius, hot, pays):
    monkeypatch.setattr(simhash, "_lookup_pays", lambda *_: pays)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    fps = planted(np.random.default_rng(words), 700, words, radius, 500, hot)
    a, b = np.array_split(fps, [len(fps) // 3])
    apart = np.bitwise_count(fps[:, None] ^ fps).sum(axis=2, dtype=np.int64)
    own, two = np.nonzero(apart <= radius), np.nonzero(apart[: len(a), len(a) :] <= radius)
    assert (forest_groups(fps, simhash.close_forest(fps, None, radius)) == simhash.spanning(*own, len(fps))).all()
    want = simhash.spanning(two[0], two[1] + len(a), len(fps))
    assert (forest_groups(fps, simhash.close_forest(a, b, radius)) == want).all()
    assert (forest_groups(fps, simhash.close_forest(b, a, radius)) == want).all()


def test_large_blocks_compare_few_pairs(monkeypatch):
    tiles, close = [], simhash._close
    monkeypatch.setattr(simhash, "_close", lambda *x: tiles.append(1) or close(*x))
    fps = planted(np.random.default_rng(7), 24_000, 4, 40, 200)
    simhash.close_forest(fps[:12_000], fps[12_000:], 42)
    assert not tiles
    hot = planted(np.random.default_rng(7), 3_000, 4, 40, 0, 9_000)
    simhash.close_forest(hot, None, 42)  # most pairs are links, which parts would meet up to 16 times
    assert tiles


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(100)] + [(500, 500)], "random": [(i, i * 7919 % 101) for i in range(100)]}[shape]
    out = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    u, v = (np.array(x) for x in zip(*edges, strict=True))
    want = simhash.spanning(u, v, 501)
    roots = {r.node: r.root for r in out}
    groups = {}
    for node, root in roots.items():
        groups.setdefault(root, set()).add(want[node])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want[list(roots)]))
