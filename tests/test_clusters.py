import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions.similarity import token_sort_ratio
from larder.operators import cluster
from larder.queries import QUERIES
from larder.queries.base import Tables

from .plain_clusters import by_blocks, lead, lead_names, lead_taxonomy


def test_lead_joins_the_first_that_fits_and_fills_gaps():
    nan = np.nan
    got = cluster.lead(np.array([[100, nan], [105, 10.0], [100, 20.0], [nan, 10.5], [200, 10.0], [0, 0.0], [0, 0.0]]))
    assert got == [0, 0, 1, 0, 2, 3, 3]


def test_spelling():
    names = ["tesco cheddar", "cheddar tesco", "tesco chedder", "milk", "milk"]
    k, score = lead_names(names, 90)
    assert k == [0, 0, 0, 1, 1]
    assert score[0] is None and score[1] == 100 and score[2] == token_sort_ratio(names[0], names[2])


def test_taxonomy_needs_both():
    values = np.array([[100.0, 5], [104, 5], [180, 5], [100, 50]])
    assert lead_taxonomy(["cheese", "cheese", "cheese", "tofu"], values, np.array([15.0, 1.5])) == [0, 0, 1, 2]


def test_average_linkage():
    v = np.array([[1, 0], [1, 0.01], [0, 1], [0.01, 1], [1, 1]], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert cluster.average_linkage(v, np.ones(5), 0.1) == [0, 0, 2, 2, 4]


def test_blocks_in_spark(spark):
    rows = [(1, "a", None, 100.0), (2, "a", None, 104.0), (3, "a", "x", 100.0), (4, "a", None, 300.0), (5, None, None, 100.0)]
    df = spark.createDataFrame(rows, "id long, name string, cat string, kcal double")
    got = {r.id: r.cluster for r in cluster.by_tolerance(df, ["name", "cat"], "id", ["kcal"], "kcal").collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}
    named = {r.id: r.cluster for r in cluster.by_spelling(df, [F.coalesce("cat", F.lit(""))], "id", "name", 93).collect()}
    assert named == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5}
    assert cluster.by_tolerance(df.limit(0), ["name"], "id", ["kcal"], "kcal").collect() == []


def test_copies_follow_the_first(spark):
    rng = np.random.default_rng(2)
    rows = [(k, ["tea", "milk tea", "milk teas", None][rng.integers(4)], float(rng.integers(1, 4) * 100) if rng.random() < 0.8 else None) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, name string, kcal double")
    got = {r.id: (r.cluster, r.score) for r in cluster.by_spelling(df, [F.lit(1)], "id", "name", 80).collect()}
    k, score = lead_names([n or "" for _, n, _ in rows], 80)
    first = {c: k.index(c) for c in k}
    assert got == {i: (first[c], s) for i, (c, s) in enumerate(zip(k, score, strict=True))}
    near = {r.id: r.cluster for r in cluster.by_tolerance(df, ["name"], "id", ["kcal"], "kcal").collect()}
    for name in {n for _, n, _ in rows}:
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        k = lead(np.array([[np.nan if r[2] is None else r[2]] for r in own]))
        assert [near[r[0]] for r in own] == [own[k.index(c)][0] for c in k]


@pytest.mark.parametrize("seed", range(5))
def test_leaders_are_those_of_all_comparisons(seed):
    rng = np.random.default_rng(seed)
    values = np.round(np.exp(rng.normal(0, 1.5, (600, 3))), 2) * rng.choice([1, 1, 1, 0, -1], (600, 3))
    values[rng.random((600, 3)) < 0.25] = np.nan
    assert cluster.lead(values) == lead(values) and len(set(lead(values))) > 20


def test_leaders_compare_few():
    values = np.round(np.exp(np.random.default_rng(1).normal(0, 3, (3000, 2))), 3)
    leaders = cluster.Leaders(2)
    met = 0
    for row in values.tolist():
        met += len(list(leaders._listed(row)))
        leaders.join(row)
    assert len(leaders.heads) > 500 and met < 3000 * len(leaders.heads) / 20


NAMES = [f"{a} {b}{c}" for a in ("cheddar", "chedder", "mild cheddar", "milk", "semi skimmed milk", "") for b in ("tesco", "tescos", "organic", "asda") for c in ("", " x", " 2")]


@pytest.mark.parametrize("least", [93, 80, 60])
def test_spelling_is_that_of_all_comparisons(spark, least):
    rng = random.Random(least)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([*NAMES, None]), rng.choice([1, 2, None])) for k in range(250)]
    df = spark.createDataFrame(rows, "cat string, id long, name string, place int")
    got = {r.id: (r.cluster, r.score) for r in cluster.by_spelling(df, [F.col("cat")], "id", "name", least, [("place", False)]).collect()}
    ordered = sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[1]))
    assert got == by_blocks(ordered, lambda held: lead_names([r[2] or "" for r in held], least))


def test_taxonomy_is_that_of_all_comparisons(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), k, rng.choice([*NAMES[:20], None]), rng.choice([None, 100.0, 104.0, 150.0, 300.0, 320.0]), rng.choice([5.0, 5.5, 9.0, 20.0])) for k in range(300)]
    df = spark.createDataFrame(rows, "cat string, id long, name string, kcal double, protein double")
    got = {r.id: (r.cluster, None) for r in cluster.by_taxonomy(df, [F.col("cat")], "id", "name", ["kcal", "protein"]).collect()}
    floors = np.array([cluster.floor_for(n) for n in ("kcal", "protein")])
    value = lambda x: np.nan if x is None else x
    solve = lambda held: (lead_taxonomy([r[2] or "" for r in held], np.array([[value(r[3]), value(r[4])] for r in held]), floors), [None] * len(held))
    assert got == by_blocks(rows, solve) and len({c for c, _ in got.values()}) > 40
    assert cluster.by_taxonomy(df.limit(0), [F.col("cat")], "id", "name", ["kcal"]).collect() == []


def test_queries_are_those_of_all_comparisons(spark):
    """The four registered queries of names, on the whole of sf0.01."""
    sf = "/root/testdata/sf0.01"
    foods = sorted(Tables(spark, sf).foods.collect(), key=lambda r: r.food_id)
    one = lambda x: {k: v[0] for k, v in x.items()}
    run = lambda name: {r.food_id: r.cluster for r in QUERIES[name](spark, sf).collect()}
    named = lambda r: [(r.category or "").strip() or ("__NOCAT_" + r.name.split()[0] if r.name.strip() else "__EMPTY__")]
    want = by_blocks([(tuple(named(r)), r.food_id, r.p_name) for r in foods if r.name is not None], lambda held: lead_names([r[2] for r in held], 93))
    assert run("spelling_dedup_93") == one(want)
    ordered = sorted(foods, key=lambda r: (r.p_name, r.food_id))
    want = by_blocks([((r.p_type, r.category), r.food_id, r.p_name) for r in ordered], lambda held: lead_names([r[2] for r in held], 80))
    assert run("reference_merge_80") == one(want)
    floors = np.array([cluster.floor_for(n) for n in ("kcal", "protein")])
    value = lambda x: np.nan if x is None else x
    solve = lambda held: (lead_taxonomy([r[2] for r in held], np.array([[value(x) for x in r[3]] for r in held]), floors), [None] * len(held))
    assert run("taxonomy_85") == one(by_blocks([((r.p_type, r.p_brand), r.food_id, r.p_name, (r.kcal, r.protein)) for r in foods], solve))
    ordered = sorted(foods, key=lambda r: (-r.kcal, r.food_id))
    solve = lambda held: (lead(np.array([[value(x) for x in r[2]] for r in held])), [None] * len(held))
    assert run("leader_cluster_10pct") == one(by_blocks([((r.p_name, r.p_type), r.food_id, (r.kcal, r.protein, r.fat)) for r in ordered], solve))


def brute_linkage(vectors, most):
    """Clusters of row numbers: the nearest two by mean distance of all pairs merge first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dist, groups = 1 - unit @ unit.T, [[k] for k in range(len(vectors))]
    while len(groups) > 1:
        d, i, j = min((dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        if d > most:
            break
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_rounds_of_linkage(spark, monkeypatch):
    """Blocks beyond ``whole`` are merged in rounds of several tiles, to the clusters of one pair after another."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(8, 5))[rng.integers(0, 8, 70)] + rng.normal(size=(70, 5)) * 0.5
    vectors[50:58] = vectors[3:11]
    rows = [(k, v.tolist(), [0, 0, 1, None][k % 4]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    real = cluster.linked
    monkeypatch.setattr(cluster, "linked", lambda large, most, whole: real(large, most, whole, tile=14))
    got = {r.id: r.cluster for r in cluster.by_meaning(df, [F.col("label")], "id", "v", 0.3, whole=16).collect()}
    want = {}
    for label in (0, 1, None):
        ids = [k for k, _, x in rows if x == label]
        for g in brute_linkage(vectors[ids], 0.3):
            want |= {ids[k]: ids[min(g)] for k in g}
    assert got == want and 4 < len(set(want.values())) < 40


def test_agglomerative_query_clusters_whole_labels(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 6)).astype(np.float32)
    vectors[60:70] = vectors[3]
    vectors[70:80] = vectors[5:15]
    rows = [(k, v.tolist(), [0, 1, None][k % 2 if k < 80 else 2]) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.cluster for r in QUERIES["agglomerative_cosine"](spark, str(tmp_path)).collect()}
    want = {}
    for label in (0, 1, None):
        ids = [r[0] for r in rows if r[2] == label]
        for g in brute_linkage(vectors[ids].astype(np.float64), 0.6):
            want |= {ids[k]: ids[min(g)] for k in g}
    assert got == want and len(set(want.values())) < 60


def test_agglomerative_buckets(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.vec_id: r.cluster for r in QUERIES["agglomerative_buckets"](spark, sf).collect()}
    t = Tables(spark, sf)
    foods = {r.food_id: (int((r.kcal or 0) / 20) * 20, int((r.protein or 0) / 2) * 2) for r in t.foods.select("food_id", "kcal", "protein").collect()}
    rows = sorted((r.vec_id, np.array(r.embedding, np.float64)) for r in t.embeddings.select("vec_id", "embedding").collect())
    held = {}
    for i, v in rows:
        held.setdefault(foods.get(i, (0, 0)), []).append((i, v / np.linalg.norm(v)))
    want = {}
    for block in held.values():
        parts = [[k] for k in range(len(block))]
        far = 1 - np.array([[a @ b for _, b in block] for _, a in block])
        while len(parts) > 1:
            least, x, y = min((far[np.ix_(parts[x], parts[y])].mean(), x, y) for x in range(len(parts)) for y in range(x))
            if least > 0.10:
                break
            parts[y] += parts.pop(x)
        want |= {block[k][0]: min(block[m][0] for m in p) for p in parts for k in p}
    assert got == want
