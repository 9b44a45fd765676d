import numpy as np
import pytest

from larder.llm import productcode
from larder.llm.queries import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("spread", [3, 100, 1 << 20, 1 << 40])
def test_nearest(seed, spread):
    rng = np.random.default_rng(seed)
    points, entries = rng.integers(-spread, spread, (300, 5)), rng.integers(-spread, spread, (rng.integers(1, 20), 5))
    entries = np.concatenate([entries, entries[:3]])
    points[:4] = entries[:1]
    code, found = productcode.nearest(points, entries)
    every = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert [int(x) for x in found] == [int(x) for x in every.min(axis=1)]
    assert code.tolist() == [min(k for k, x in enumerate(row) if x == min(row)) for row in every.tolist()]


def test_only_the_annulus_is_compared(monkeypatch):
    """Of entries far from each other in norm, few are compared."""
    compared = []
    rng = np.random.default_rng(3)
    entries = np.outer(np.arange(1, 257) * 100, np.ones(4, np.int64)).astype(np.int64)
    points = entries[rng.integers(0, 256, 1000)] + rng.integers(-5, 6, (1000, 4))
    real = np.repeat
    monkeypatch.setattr(np, "repeat", lambda x, n, *a: (compared.append(int(np.sum(n))), real(x, n, *a))[1])
    code, _ = productcode.nearest(points, entries)
    monkeypatch.undo()
    assert (entries[code] == np.rint(points.mean(axis=1) / 100)[:, None] * 100).all()
    assert max(compared) <= 3 * len(points)


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Everything compared with everything, in Python's integers."""
    use = sorted(((i, [int(np.floor(scale * np.float64(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: r[:2])
    size = len(use[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    cuts = [cut(v) for _, v, _ in use]
    books = [[c[p] for c in cuts[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(c[p], books[p])[1] for c in cuts]
            for k in set(got):
                mine = [c[p] for c, g in zip(cuts, got, strict=True) if g == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cuts]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(use, errors, strict=True):
        total[label] = total.get(label, 0) + e
    text = ",".join(str(x) for book in books for c in book for x in c)
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, total[label], text) for (i, _, label), f, e in zip(use, found, errors, strict=True))


def test_sql(spark):
    assert same(spark, QUERIES["op13_product_code"], ORACLES["op13_product_code"], "/root/testdata/sf0.001") == 500


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=16), 2)], [1, 2, None][k % 3]) for k in range(120)]
    rows += [(k, rows[7][1], 2) for k in range(200, 260)] + [(7, rows[7][1], None)]
    odd = [(300, None, 1), (301, [None] + [0.0] * 15, 1), (302, [float("nan")] + [0.0] * 15, 1), (303, [float("-inf")] * 16, None), (304, [], 1)]
    other = [(None, [1.0] * 16, 1), (305, [1.0] * 8, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd + other], "vec_id long, embedding array<double>, label int, part int, code string")
    got = sorted(tuple(r) for r in productcode.encode(df).collect())
    assert got == plain(rows + odd)
    few = productcode.encode(df.where("vec_id < 5")).collect()
    assert sorted(tuple(r) for r in few) == plain(rows[:5])
    assert productcode.encode(df.limit(0)).collect() == [] and productcode.encode(df.where("vec_id >= 300 and vec_id < 305")).collect() == []
    assert productcode.encode(df.where("vec_id < 9"), parts=3).collect() == []


def test_large_components(spark):
    rows = [(k, [float((k % 5) * 10.0**9 + k), float(-k * 10.0**7)], 1) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    top = (1 << 63) - 1
    want = [(i, c, min(e, top), min(t, top), b) for i, c, e, t, b in plain(rows, parts=2, entries=3, rounds=3)]
    assert sorted(tuple(r) for r in productcode.encode(df, parts=2, entries=3, rounds=3).collect()) == want
