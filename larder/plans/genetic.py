"""Plan search by a genetic algorithm on islands.

Each island is a row; a task evolves its islands in numpy with a generator seeded by the island's number, so a lost task gives the same plans again. The
food table is a candidate set of a checked size, sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_seasoning, meat_kind, spice_kind
from ..functions.fixed import DAILY_MICROS
from ..operators.columns import q
from .scoring import POINTS, PRIORITY, TIER_1, TIER_3, TIERS, WEEKLY

MOST_FOODS = 5000


@dataclass
class Problem:
    """Foods as arrays and what plans are scored against."""

    ids: np.ndarray
    amounts: np.ndarray  # foods x (calories, nutrients), per 100 g
    names: list[str]  # of the columns of amounts
    meat: np.ndarray
    spice: np.ndarray
    seasoning: np.ndarray
    kcal: float
    targets: Mapping[str, tuple[float, float | None]]
    days: int
    per_day: int
    most_grams: float = 300.0

    def __post_init__(self) -> None:
        self.prepare()

    def deviation(self, dev: np.ndarray, name: str) -> np.ndarray:
        width, steep = TIERS[1 if name in TIER_1 else 3 if name in TIER_3 else 2]
        penalty = np.expm1(np.minimum(steep * dev / width, 700)) / np.expm1(steep)
        return np.where(dev <= 0, 1.0, np.maximum(0.01, 1 - 0.9 * penalty))

    def fitness(self, food: np.ndarray, grams: np.ndarray) -> float:
        return float(self.fitnesses(food[None], grams[None])[0])

    def fitnesses(self, food: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The scores of plans (plans x days x foods of a day), worked out together."""
        plans, col = len(food), self.names.index
        daily = np.einsum("pdsn,pds->pdn", self.amounts[food], grams / 100)
        week = daily.sum(axis=1)
        parts = [np.maximum(0.0, 1 - 2 * np.abs(1 - week[:, 0] / (self.kcal * self.days)))]
        for n, (low, high) in self.targets.items():
            if not low:
                continue
            total = week[:, col(n)]
            r = total / (low * self.days)
            score = np.select([r >= 1, r >= 0.95, r >= 0.90, r >= 0.80], [1.0, 0.95, 0.85, 0.70], 0.6 * r)
            if high:
                score = np.where(total > high * self.days, np.maximum(0.0, 1 - 10 * (total / (high * self.days) - 1)), score)
            parts += [score] * (2 if n in PRIORITY else 1)
        goal = {"calories": self.kcal} | {m: self.targets[m][0] for m in ("protein", "fat", "carbohydrate") if m in self.targets}
        macros = np.mean([self.deviation(np.abs(daily[..., col(n)] - t) / t, n) for n, t in goal.items() if t], axis=(0, 2))
        live = [n for n in DAILY_MICROS if n in self.targets and self.targets[n][0]]
        dev = [np.abs(daily[..., col(n)] - self.targets[n][0]) / self.targets[n][0] for n in live]
        micros = np.mean([np.select([d <= 0.3, d <= 0.5, d <= 0.7], [1.0, 0.8, 0.5], 0.2) for d in dev], axis=(0, 2)) if live else np.ones(plans)
        threes = np.array(list(combinations(range(food.shape[2]), 3)), np.int64).reshape(-1, 3)
        a, b, c = np.moveaxis(np.sort(food, axis=2).astype(np.int64)[..., threes], -1, 0)
        keys = np.sort(((a * len(self.ids) + b) * len(self.ids) + c).reshape(plans, -1), axis=1)
        most = max(1, round(self.days / 3))
        over = (keys[:, most:] == keys[:, :-most]).sum(axis=1)  # of n equal ones, n - most
        flat = np.sort(food.reshape(plans, -1), axis=1)
        unique = 1 + (flat[:, 1:] != flat[:, :-1]).sum(axis=1)
        held = lambda kinds, kind: np.where(kinds[food] == kind, grams, 0.0).sum(axis=(1, 2))
        loss = lambda kinds, kind: np.minimum(0.5, WEEKLY[kind][1] * np.maximum(0.0, held(kinds, kind) / WEEKLY[kind][0] - 1))
        score = {
            "nutrients": np.mean(parts, axis=0), "macros": macros if self.days > 1 else 1.0, "micros": micros if self.days > 1 else 1.0, "variety": np.maximum(0.0, 1 - 0.1 * over),
            "unique": np.minimum(1.0, unique / (2 * self.per_day)), "meat": np.maximum(0.0, 1 - loss(self.meat, "red") - loss(self.meat, "processed")),
            "spice": np.maximum(0.0, 1 - loss(self.spice, "spice") - loss(self.spice, "herb")), "seasoning": np.mean(self.seasoning[food].sum(axis=2) >= 3, axis=1),
        }
        return sum(POINTS[k] * v for k, v in score.items())

    def prepare(self) -> None:
        """What seeding reads: nutrients from the rarest on, each food's bucket (the nutrient to whose minimum it gives most, weighted by rarity; -1 for none) and what it gives to the others."""
        lows = np.array([self.kcal if n == "calories" else (self.targets[n][0] or 0.0) for n in self.names])
        live = np.nonzero((lows > 0) & (np.array(self.names) != "calories"))[0]
        share = self.amounts[:, live] / lows[live]
        known = self.amounts[:, 0] > 10
        means = (share[known] / (self.amounts[known, :1] / 100)).mean(axis=0) if known.any() else np.zeros(len(live))
        rare = np.log1p(1 / np.maximum(means, 0.001))
        value = share * rare
        self.rarest = np.argsort(-rare, kind="stable")
        fits = (self.amounts[:, 0] >= 10) & (value.max(axis=1, initial=0) > 0)
        self.bucket = np.where(fits, value.argmax(axis=1) if len(live) else -1, -1)
        self.secondary = np.maximum(value.sum(axis=1) - value.max(axis=1, initial=0), 0.01)
        self.fillers = np.nonzero(self.amounts[:, 0] >= 10)[0]

    def stratified(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """n foods: one of each nutrient's bucket, the rarest nutrient first, by softmax of what else they give at temperature 1.5, then a fill of any others at 2. Foods repeat only where there are fewer than n."""
        taken = np.zeros(len(self.ids), bool)
        out: list[int] = []

        def draw(among: np.ndarray, temperature: float) -> None:
            # The largest score with Gumbel noise is a draw by softmax.
            k = int(among[np.argmax(self.secondary[among] / temperature + rng.gumbel(size=len(among)))])
            taken[k] = True
            out.append(k)

        for nutrient in self.rarest:
            among = np.nonzero((self.bucket == nutrient) & ~taken)[0]
            if len(out) < n and len(among):
                draw(among, 1.5)
        while len(out) < n and len(among := self.fillers[~taken[self.fillers]]):
            draw(among, 2.0)
        rest = np.nonzero(~taken)[0] if len(out) < n else []
        out += list(rest[: n - len(out)])
        return np.resize(np.array(out, np.int64), n)

    def seed(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """A random plan: two seasonings a day, the rest stratified by nutrients."""
        food = np.stack([self.stratified(rng, self.per_day) for _ in range(self.days)])
        grams = rng.uniform(50, self.most_grams, food.shape)
        tasty = np.nonzero(self.seasoning)[0]
        n = min(2, self.per_day) if len(tasty) else 0
        if n:
            # Seasonings take the last places: those of the fill pass, or of the least rare nutrients.
            food[:, -n:] = rng.choice(tasty, (self.days, n))
            dried = self.spice[food[:, -n:]] == "spice"
            grams[:, -n:] = np.where(dried, rng.uniform(2, 8, (self.days, n)), rng.uniform(10, 30, (self.days, n)))
        return food, grams

    def evolve(self, seed: int, population: int = 60, generations: int = 100, crossover: float = 0.7, mutation: float = 0.15, elite: int = 5, enough: float = 95) -> tuple[np.ndarray, np.ndarray, float]:
        rng = np.random.default_rng(seed)
        plans = [self.seed(rng) for _ in range(population)]
        best, top = plans[0], -1.0
        for _ in range(generations):
            scores = self.fitnesses(*(np.stack(x) for x in zip(*plans, strict=True)))
            order = np.argsort(-scores, kind="stable")
            if scores[order[0]] > top:
                best, top = plans[order[0]], float(scores[order[0]])
            if top >= enough:
                break
            pick = lambda: plans[max(rng.integers(0, population, 3), key=lambda k: scores[k])]  # noqa: B023, E731
            after = [plans[k] for k in order[:elite]]
            while len(after) < population:
                (fa, ga), (fb, gb) = pick(), pick()
                swap = (rng.random(self.days) < 0.5)[:, None] if rng.random() < crossover else np.zeros((self.days, 1), bool)
                food, grams = np.where(swap, fb, fa), np.where(swap, gb, ga)
                for d in np.nonzero(rng.random(self.days) < mutation)[0]:
                    k, kind = rng.integers(self.per_day), rng.integers(3)
                    if kind == 0:
                        food[d, k] = rng.integers(len(self.ids))
                    elif kind == 1:
                        grams[d, k] = rng.uniform(30, self.most_grams)
                    else:
                        e = rng.integers(self.days)
                        food[[d, e]], grams[[d, e]] = food[[e, d]], grams[[e, d]]
                after.append((food, grams))
            plans = after
        return *best, top


def problem(foods: DataFrame, kcal: float, targets: Mapping[str, tuple[float, float | None]], days: int = 7, per_day: int = 6) -> Problem:
    """From foods (food_id, name, calories, nutrients), a candidate set of MOST_FOODS at most."""
    names = ["calories", *targets]
    rows = foods.select("food_id", *(F.coalesce(q(n), F.lit(0.0)).cast("double").alias(n) for n in names), meat_kind("name").alias("_m"), spice_kind("name").alias("_s"), is_seasoning("name").alias("_t"))
    got = rows.orderBy("food_id").limit(MOST_FOODS + 1).toPandas()
    if not 0 < len(got) <= MOST_FOODS:
        raise ValueError(f"plans need 1 to {MOST_FOODS} candidate foods; choose the best sources first")
    kinds = lambda c: got[c].fillna("").to_numpy(object)
    return Problem(got["food_id"].to_numpy(), got[names].to_numpy(np.float64), names, kinds("_m"), kinds("_s"), got["_t"].to_numpy(bool), kcal, targets, days, per_day)


def search(foods: DataFrame, kcal: float, targets: Mapping[str, tuple[float, float | None]], days: int = 7, per_day: int = 6, islands: int = 8, seed: int = 42, **how) -> DataFrame:
    """(day, slot, food_id, grams, fitness, status) of the best plan of all islands; Optimal from a fitness of 80 on."""
    task = problem(foods, kcal, targets, days, per_day)
    spark = foods.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for island in pdf["id"]:
                food, grams, top = task.evolve(seed + int(island), **how)
                yield pd.DataFrame({"island": [island], "fitness": [top], "food_id": [task.ids[food].tolist()], "grams": [grams.round(1).tolist()]})

    # An island's plan is one row, so the best is chosen without a second run.
    plans = spark.range(0, islands, 1, islands).mapInPandas(run, "island long, fitness double, food_id array<array<long>>, grams array<array<double>>")
    best = plans.orderBy(F.desc("fitness"), "island").limit(1)
    days_ = best.select("fitness", F.posexplode(F.arrays_zip("food_id", "grams")).alias("day", "d"))
    rows = days_.select("fitness", F.col("day").cast("long").alias("day"), F.posexplode(F.arrays_zip("d.food_id", "d.grams")).alias("slot", "s"))
    return rows.select("day", F.col("slot").cast("long").alias("slot"), "s.food_id", "s.grams", F.round("fitness", 6).alias("fitness"), F.when(F.col("fitness") >= 80, "Optimal").otherwise("Feasible").alias("status"))
