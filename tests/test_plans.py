from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.plans import genetic, milp, scoring
from larder.sources.files import mock_foods

TARGETS = {"protein": (100.0, 250.0), "fat": (40.0, 100.0), "carbohydrate": (100.0, 400.0)}


@pytest.fixture(scope="module")
def foods(spark):
    wide = mock_foods(spark).select(F.col("id").cast("long").alias("food_id"), "name", "calories", *(F.col("nutrients")[n].alias(n) for n in TARGETS))
    extra = spark.createDataFrame([(7, "Spices, paprika", 282.0, 14.0, 13.0, 54.0), (8, "Soy sauce", 53.0, 8.0, 0.6, 4.9), (9, "Basil, fresh", 23.0, 3.2, 0.6, 2.7), (10, "Beef steak", 250.0, 26.0, 15.0, 0.0)], wide.schema)
    return wide.unionAll(extra).cache()


def test_fitness_of_search_equals_query(spark, foods):
    task = genetic.problem(foods, 2000.0, TARGETS, days=3, per_day=5)
    food, grams = task.seed(np.random.default_rng(1))
    rows = [(1, d, k, int(task.ids[food[d, k]]), float(grams[d, k])) for d in range(3) for k in range(5)]
    items = spark.createDataFrame(rows, "plan_id long, day int, slot int, food_id long, grams double")
    got = scoring.fitness(items, foods, 2000.0, TARGETS, 3, 5).first()
    assert got.fitness == pytest.approx(task.fitness(food, grams))


def test_search_improves_and_repeats(spark, foods):
    task = genetic.problem(foods, 2000.0, TARGETS, days=3, per_day=5)
    start = max(task.fitness(*task.seed(np.random.default_rng(k))) for k in range(10))
    run = lambda: sorted(map(tuple, genetic.search(foods, 2000.0, TARGETS, days=3, per_day=5, islands=2, population=20, generations=15).collect()))
    first = run()
    assert first == run()
    assert len(first) == 15 and first[0][4] > start


def test_simplex():
    x = milp.simplex(np.array([2.0, 3.0]), np.array([[-1.0, -1.0], [1.0, 0.0]]), np.array([-4.0, 1.0]))
    assert x == pytest.approx([1, 3])
    assert milp.simplex(np.array([1.0]), np.array([[1.0], [-1.0]]), np.array([1.0, -2.0])) is None


def test_fewest_foods_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(8):
        amounts = rng.uniform(0, 3, (2, 5))
        low, high = np.array([600.0, 300.0]), np.array([700.0, np.inf])
        pack = np.array([0, 100, 0, 250, 0.0])
        grams, status = milp.solve(amounts, low, high, pack, most=300)
        best = None
        for used in product([0, 1], repeat=5):
            on = [k for k in range(5) if used[k]]
            for packs in product(*[range(1, int(300 // pack[k]) + 1) if pack[k] else [None] for k in on]):
                fixed = np.zeros(5)
                for k, p in zip(on, packs, strict=True):
                    fixed[k] = p * pack[k] if p else 0
                free = [k for k in on if not pack[k]]
                rows = np.concatenate([amounts[:1], -amounts])
                right = np.concatenate([high[:1], -low]) - rows @ fixed
                limit = np.eye(len(free))
                x = milp.simplex(np.ones(len(free)), np.concatenate([rows[:, free], limit]), np.concatenate([right, np.full(len(free), 300.0)])) if free else (np.zeros(0) if (right >= -1e-9).all() else None)
                if x is not None:
                    best = min(best or 9, sum(used))
        assert (grams is None) == (best is None)
        if best is not None:
            assert status == "Optimal" and (grams > 0).sum() == best
            assert (amounts @ grams >= low - 1e-3).all() and (amounts @ grams <= high + 1e-3).all()
            assert all(abs(g / p - round(g / p)) < 1e-4 for g, p in zip(grams, pack, strict=True) if p)


def test_plan_or_no_plan(spark, foods):
    people = spark.createDataFrame([(1, 2000.0), (2, 60000.0)], "profile_id long, kcal double")
    got = milp.plan(foods, people, {"protein": (100.0, None)}, seconds=10).collect()
    assert any(r.profile_id == 1 and r.grams > 0 for r in got)
    assert [r.status for r in got if r.profile_id == 2] == ["Infeasible"]


def _foods(n=120):
    rng = np.random.default_rng(4)
    amounts = np.concatenate([rng.uniform(5, 500, (n, 1)), rng.uniform(0, 30, (n, 3))], axis=1)
    kinds = np.array([""] * n, object)
    kinds[:6] = "herb"
    return genetic.Problem(np.arange(n) + 1, amounts, ["calories", "protein", "Iron (mg)", "fat"], np.array([""] * n, object), kinds, np.arange(n) < 6, 2000.0, {"protein": (60.0, 400.0), "Iron (mg)": (18.0, 45.0), "fat": (50.0, None)}, 7, 6)


def test_stratified_seeds():
    task = _foods()
    for k in range(20):
        out = task.stratified(np.random.default_rng(k), 6)
        assert len(set(out.tolist())) == 6
        # The first foods are of the nutrients' buckets, the rarest nutrient first.
        buckets = [n for n in task.rarest if (task.bucket == n).any()]
        assert [task.bucket[f] for f in out[: len(buckets)]] == buckets
        assert (task.amounts[out, 0] >= 10).all()
    assert len(task.stratified(np.random.default_rng(1), 500)) == 500


def test_fitness_of_many_is_that_of_each():
    task, rng = _foods(), np.random.default_rng(3)
    food, grams = (np.stack(x) for x in zip(*(task.seed(rng) for _ in range(15)), strict=True))
    food[3] = food[3][:1]
    assert np.allclose(task.fitnesses(food, grams), [task.fitness(f, g) for f, g in zip(food, grams, strict=True)])
    trios = Counter(t for row in food[3].tolist() for t in combinations(sorted(row), 3))
    assert sum(max(0, n - 2) for n in trios.values()) == 20 * 5


def test_node_limit_is_reproducible():
    rng = np.random.default_rng(8)
    amounts = rng.uniform(0, 2, (3, 30))
    low, high = np.array([900.0, 500.0, 700.0]), np.array([1000.0, np.inf, np.inf])
    runs = [milp.solve(amounts, low, high, np.where(np.arange(30) % 2, 45.0, 0.0), nodes=40) for _ in range(2)]
    assert runs[0][1] == runs[1][1] == "Feasible (Node Limit)" and (runs[0][0] == runs[1][0]).all()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_registered_searches_find_plans(spark, sf):
    """At every size: no energy without a plan, and a week of ten foods a day at most from the genetic search."""
    from larder.queries import QUERIES

    rows = QUERIES["milp_diet"](spark, f"/root/testdata/sf{sf}").groupBy("status").agg(F.count("food_id").alias("n")).collect()
    assert rows and all(r.n > 0 and r.status.split()[0] in ("Optimal", "Feasible") for r in rows)
    found = QUERIES["ga_islands"](spark, f"/root/testdata/sf{sf}").collect()
    assert found and {r.status.split()[0] for r in found} <= {"Optimal", "Feasible"} and found[0].fitness > 60


def brute_trios(rows, most):
    """Threes of each day's list by place, counted over a plan's days."""
    days, counts = {}, {}
    for plan, day, food in rows:
        counts.setdefault(plan, Counter())
        if food is not None:
            days.setdefault((plan, day), []).append(food)
    for (plan, _), held in days.items():
        counts[plan].update(combinations(sorted(held), 3))
    return {plan: sum(max(0, n - most) for n in c.values()) for plan, c in counts.items()}


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_trios_are_those_of_all_threes(spark, most):
    rng = np.random.default_rng(most)
    rows = [(int(rng.integers(0, 12)) if rng.random() < 0.9 else None, int(rng.integers(0, 5)) if rng.random() < 0.9 else None, int(rng.integers(0, 9)) if rng.random() < 0.95 else None) for _ in range(700)]
    rows.append((77, 1, None))
    df = spark.createDataFrame(rows, "plan_id int, day int, food_id int")
    got = {r.plan_id: r.violations for r in scoring.trios(df, most).collect()}
    assert got == brute_trios(rows, most) and (most > 2 or sum(got.values()) > 100)


def test_trios_of_large_days(spark):
    """2,000 foods on each of three days: 1.3 billion threes, three kinds of foods."""
    day = spark.range(2000).select(F.lit(1).alias("plan_id"), F.col("id").alias("food_id"))
    items = day.withColumn("day", F.lit(0)).unionByName(day.withColumn("day", F.lit(1))).unionByName(day.where("food_id < 1500").withColumn("day", F.lit(2)))
    assert scoring.trios(items, 2).collect()[0].violations == 1500 * 1499 * 1498 // 6
    assert scoring.trios(items.limit(0), 2).collect() == []
