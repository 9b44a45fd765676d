"""Plan totals, compliance and fitness as relational queries.

Items: (plan_id, day, slot, food_id, grams). Foods: (food_id, name, nutrients as columns). Unknown foods are skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_seasoning, meat_kind, spice_kind
from ..functions.fixed import DAILY_MICROS
from ..operators.columns import q
from ..operators.settle import settled

# Tolerance and steepness of the daily score by tier, and the tiers' nutrients (others are of tier 2).
TIERS = {1: (0.10, 5.0), 2: (0.25, 4.0), 3: (0.50, 3.0)}
TIER_1 = ["calories", "protein", "carbohydrate", "fat", "Fiber (g)"]
TIER_3 = [
    "Iron (mg)", "Zinc (mg)", "Vitamin D (mcg)", "Vitamin A (mcg RAE)", "Vitamin E (mg)", "Vitamin K (mcg)", "Omega-3 (ALA) (g)", "Omega-6 (Linoleic) (g)", "Selenium (mcg)",
    "Iodine (mcg)", "Vitamin B12 (mcg)", "Calcium (mg)", "Magnesium (mg)", "Phosphorus (mg)", "Copper (mg)", "Manganese (mg)", "Molybdenum (mcg)", "Biotin (mcg)",
]
# Nutrients that count twice.
PRIORITY = [
    "protein", "fat", "carbohydrate", "Vitamin A (mcg RAE)", "Vitamin C (mg)", "Vitamin E (mg)", "Vitamin K (mcg)", "Thiamin (B1) (mg)", "Riboflavin (B2) (mg)", "Niacin (B3) (mg NE)",
    "Vitamin B6 (mg)", "Folate (mcg DFE)", "Vitamin B12 (mcg)", "Calcium (mg)", "Iron (mg)", "Magnesium (mg)", "Phosphorus (mg)", "Potassium (mg)", "Zinc (mg)", "Selenium (mcg)",
]
# Weekly grams, and the weight of a relative excess.
WEEKLY = {"red": (500.0, 0.5), "processed": (70.0, 0.5), "spice": (30.0, 0.3), "herb": (100.0, 0.3)}
# Points of each part of a plan's fitness.
POINTS = {"nutrients": 20, "macros": 25, "micros": 10, "variety": 10, "unique": 5, "meat": 10, "spice": 5, "seasoning": 15}

Targets = Mapping[str, tuple[float, float | None]]


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


def totals(items: DataFrame, foods: DataFrame, nutrients: Sequence[str], by: Sequence[str] = ("plan_id", "day")) -> DataFrame:
    """Sums of each nutrient, given per 100 g, over the items' grams."""
    sums = [F.sum(F.coalesce(q(n), F.lit(0.0)) * F.col("grams") / 100.0).alias(n) for n in nutrients]
    return items.join(foods.select("food_id", *map(q, nutrients)), "food_id").groupBy(*by).agg(*sums)


def daily_average(items: DataFrame, foods: DataFrame, nutrients: Sequence[str], days: int, digits: int = 2) -> DataFrame:
    week = totals(items, foods, nutrients, ["plan_id"])
    return week.select("plan_id", *(F.round(q(n) / days, digits).alias(n) for n in nutrients))


def shopping_list(items: DataFrame, foods: DataFrame) -> DataFrame:
    return items.join(foods.select("food_id", "name"), "food_id").groupBy("plan_id", "name").agg(F.round(F.sum("grams"), 1).alias("grams"))


def deviation_score(deviation: Column, nutrient: str) -> Column:
    """1 at no deviation, 0.1 at the tier's tolerance, 0.01 at least."""
    width, steep = TIERS[1 if nutrient in TIER_1 else 3 if nutrient in TIER_3 else 2]
    penalty = (F.exp(steep * deviation / width) - 1) / (F.exp(F.lit(steep)) - 1)
    return F.when(deviation <= 0, 1.0).otherwise(F.greatest(F.lit(0.01), 1.0 - 0.9 * penalty))


def _nutrient_share(kcal: float, targets: Targets, days: int) -> Column:
    """The mean score of a plan's totals; nutrients without a minimum don't count."""
    parts = [F.greatest(F.lit(0.0), 1 - 2 * F.abs(1 - F.col("calories") / (kcal * days)))] if kcal > 0 else []
    for n, (low, high) in targets.items():
        if not low:
            continue
        ratio = q(n) / (low * days)
        over = F.greatest(F.lit(0.0), 1 - 10 * (q(n) / ((high or 1) * days) - 1))
        score = F.when(ratio >= 1, 1.0).when(ratio >= 0.95, 0.95).when(ratio >= 0.90, 0.85).when(ratio >= 0.80, 0.70).otherwise(0.6 * ratio)
        parts += [F.when(q(n) > high * days, over).otherwise(score) if high else score] * (2 if n in PRIORITY else 1)
    return _sum(parts) / max(1, len(parts))


def nutrient_score(week: DataFrame, kcal: float, targets: Targets, days: int) -> DataFrame:
    """(plan_id, nutrients) from a plan's totals."""
    return week.select("plan_id", _nutrient_share(kcal, targets, days).alias("nutrients"))


def _day_scores(kcal: float, targets: Targets) -> tuple[Column, Column]:
    """Aggregates over a plan's days: the means of the daily scores of macros and of micros."""
    goal = {"calories": kcal} | {m: targets[m][0] for m in ("protein", "fat", "carbohydrate") if m in targets}
    macros = [deviation_score(F.abs(q(n) - t) / t, n) for n, t in goal.items() if t]
    steps = lambda d: F.when(d <= 0.30, 1.0).when(d <= 0.50, 0.8).when(d <= 0.70, 0.5).otherwise(0.2)
    micros = [steps(F.abs(q(n) - targets[n][0]) / targets[n][0]) for n in DAILY_MICROS if n in targets and targets[n][0]]
    mean = lambda parts, none: F.avg(_sum(parts) / len(parts)) if parts else F.lit(none)
    return mean(macros, 0.0), mean(micros, 1.0)


def balance_scores(daily: DataFrame, kcal: float, targets: Targets) -> DataFrame:
    """(plan_id, macros, micros): means over days of the daily scores; both 1 for plans of one day."""
    macros, micros = _day_scores(kcal, targets)
    many = F.count("*") > 1
    return daily.groupBy("plan_id").agg(F.when(many, macros).otherwise(1.0).alias("macros"), F.when(many, micros).otherwise(1.0).alias("micros"))


def _rows_fixed(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later expressions read them: the optimizer doesn't copy through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def trios(items: DataFrame, most: int) -> DataFrame:
    """(plan_id, violations): for every three foods that share days more than ``most`` times, the times beyond, summed. Repeated foods of a day count as often as they stand.

    How often three foods meet follows from the days on which each stands. Foods of a plan that stand on the same days, equally often, are one kind with a number, and kinds, not foods, are combined: first
    alone, then in twos, then in threes, and only while their days can still give more than ``most``. A week has few kinds however many foods its days have.
    """
    day = F.coalesce(F.col("day").cast("string"), F.lit("\0"))
    held = items.where(F.col("food_id").isNotNull()).groupBy("plan_id", "food_id", day.alias("_day")).agg(F.count("*").alias("_c"))
    foods = held.groupBy("plan_id", "food_id").agg(F.sort_array(F.collect_list(F.struct("_day", "_c"))).alias("_days"), F.max("_c").alias("_top"), F.sum("_c").alias("_all"))
    kinds = foods.groupBy("plan_id", "_days").agg(F.count("*").alias("_n"), F.first("_top").alias("_top"), F.first("_all").alias("_all"))
    plan = Window.partitionBy("plan_id")
    # No food stands more than ``_most`` times on a day, so what meets w times gives at most w times that with one food more.
    kinds = kinds.withColumn("_most", F.max("_top").over(plan)).where(F.col("_all") * F.col("_most") * F.col("_most") > most)
    # What can't give more is gone, so the kinds are few; they are read several times.
    kinds = settled(kinds.withColumn("_k", F.row_number().over(plan.orderBy("_days"))))

    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["w"])
    weights = lambda days, w: F.filter(F.transform(days, lambda e: F.struct(e["_day"].alias("_day"), w(e).alias("w"))), lambda e: e["w"] > 0)
    of_days = lambda name: F.map_from_entries(name)
    over = lambda met, times: F.greatest(F.lit(0).cast("long"), met - most) * times
    two = lambda n: n * (n - 1) / 2
    named = lambda tag: kinds.select(F.col("plan_id").alias(f"_p{tag}"), F.col("_k").alias(f"_k{tag}"), F.col("_n").alias(f"_n{tag}"), of_days("_days").alias(f"_m{tag}"))

    # One food three times; one twice and another.
    alone = kinds.select("plan_id", over(total(weights("_days", lambda e: (e["_c"] * (e["_c"] - 1) * (e["_c"] - 2) / 6).cast("long"))), F.col("_n")).alias("v"))
    y = named("y")
    pairs = kinds.join(y, F.col("plan_id").eqNullSafe(F.col("_py")))
    twice = pairs.where("_most > 1").select("plan_id", over(total(weights("_days", lambda e: (e["_c"] * (e["_c"] - 1) / 2).cast("long") * F.coalesce(F.col("_my")[e["_day"]], F.lit(0)))), F.when(F.col("_k") == F.col("_ky"), F.col("_n") * (F.col("_n") - 1)).otherwise(F.col("_n") * F.col("_ny"))).alias("v"))
    met = weights("_days", lambda e: e["_c"] * F.coalesce(F.col("_my")[e["_day"]], F.lit(0)))
    pairs = pairs.where("_k <= _ky").select("plan_id", "_most", "_k", "_ky", "_n", "_ny", met.alias("_met")).where(total("_met") * F.col("_most") > most)
    z = named("z")
    threes = pairs.join(z, F.col("plan_id").eqNullSafe(F.col("_pz")) & (F.col("_ky") <= F.col("_kz")))
    times = (
        F.when((F.col("_k") == F.col("_ky")) & (F.col("_ky") == F.col("_kz")), F.col("_n") * (F.col("_n") - 1) * (F.col("_n") - 2) / 6).when(F.col("_k") == F.col("_ky"), two(F.col("_n")) * F.col("_nz"))
        .when(F.col("_ky") == F.col("_kz"), two(F.col("_ny")) * F.col("_n")).otherwise(F.col("_n") * F.col("_ny") * F.col("_nz"))
    )
    apart = threes.select("plan_id", over(total(weights("_met", lambda e: e["w"] * F.coalesce(F.col("_mz")[e["_day"]], F.lit(0)))), times.cast("long")).alias("v"))
    zero = items.select("plan_id", F.lit(0).cast("long").alias("v"))
    return zero.unionByName(alone).unionByName(twice).unionByName(apart).groupBy("plan_id").agg(F.sum("v").alias("violations"))


def _kind_losses() -> tuple[Column, Column]:
    """What is left of 1 after the excess of weekly grams of meat, and of spices and herbs."""
    loss = lambda c, kind: F.least(F.lit(0.5), WEEKLY[kind][1] * F.greatest(F.lit(0.0), (F.col(c) - WEEKLY[kind][0]) / WEEKLY[kind][0]))
    return F.greatest(F.lit(0.0), 1 - loss("red", "red") - loss("processed", "processed")), F.greatest(F.lit(0.0), 1 - loss("spices", "spice") - loss("herb", "herb"))


def kind_scores(items: DataFrame, foods: DataFrame) -> DataFrame:
    """(plan_id, red, processed, spice, herb, meat_score, spice_score): weekly grams by kind and what is left of 1 after their excess."""
    named = items.join(foods.select("food_id", meat_kind("name").alias("meat"), spice_kind("name").alias("spice")), "food_id")
    grams = lambda c, kind: F.coalesce(F.sum(F.when(F.col(c) == kind, F.col("grams"))), F.lit(0.0)).alias(kind)
    out = named.groupBy("plan_id").agg(grams("meat", "red"), grams("meat", "processed"), grams("spice", "spice").alias("spices"), grams("spice", "herb"))
    meat, spice = _kind_losses()
    return out.withColumns({"meat_score": meat, "spice_score": spice})


def seasoning_score(items: DataFrame, foods: DataFrame, least: int = 3) -> DataFrame:
    """(plan_id, seasoning): share of days with ``least`` seasonings."""
    named = items.join(foods.select("food_id", is_seasoning("name").cast("int").alias("s")), "food_id", "left")
    day = named.groupBy("plan_id", "day").agg(F.sum(F.coalesce("s", F.lit(0))).alias("n"))
    return day.groupBy("plan_id").agg(F.avg((F.col("n") >= least).cast("double")).alias("seasoning"))


def fitness(items: DataFrame, foods: DataFrame, kcal: float, targets: Targets, days: int, foods_a_day: int) -> DataFrame:
    """(plan_id, parts from 0 to 1, fitness from 0 to 100) of every plan.

    The items are joined once: a row a plan and day holds all that the parts need, then a row a plan; ``trios`` counts threes of foods beside it. Foods that aren't known add no amounts.
    """
    nutrients = ["calories", *targets]
    facts = foods.select("food_id", *map(q, nutrients), meat_kind("name").alias("_meat"), spice_kind("name").alias("_spice"), is_seasoning("name").cast("int").alias("_seasoning"))
    kinds = {"red": "_meat", "processed": "_meat", "spice": "_spice", "herb": "_spice"}
    grams = F.col("grams")
    daily = items.join(facts, "food_id", "left").groupBy("plan_id", "day").agg(
        *(F.sum(F.coalesce(q(n), F.lit(0.0)) * grams / 100.0).alias(n) for n in nutrients),
        *(F.coalesce(F.sum(F.when(F.col(c) == kind, grams)), F.lit(0.0)).alias(f"_{kind}") for kind, c in kinds.items()),
        F.sum(F.coalesce("_seasoning", F.lit(0))).alias("_seasonings"), F.collect_set("food_id").alias("_foods"),
    )
    macros, micros = _day_scores(kcal, targets)
    many = F.count("*") > 1
    week = daily.groupBy("plan_id").agg(
        *(F.sum(q(n)).alias(n) for n in nutrients), *(F.sum(f"_{k}").alias("spices" if k == "spice" else k) for k in kinds),
        F.when(many, macros).otherwise(1.0).alias("macros"), F.when(many, micros).otherwise(1.0).alias("micros"),
        F.avg((F.col("_seasonings") >= 3).cast("double")).alias("seasoning"), F.collect_list("_foods").alias("_days"),
    )
    repeated = trios(items, max(1, round(days / 3))).select(F.col("plan_id").alias("_plan"), F.col("violations").alias("_over"))
    week = week.join(repeated, F.col("plan_id").eqNullSafe(F.col("_plan")))
    meat, spice = _kind_losses()
    parts = {
        "nutrients": _nutrient_share(kcal, targets, days), "variety": F.greatest(F.lit(0.0), 1 - 0.1 * F.col("_over")),
        "unique": F.least(F.lit(1.0), F.size(F.array_distinct(F.flatten("_days"))) / (2.0 * foods_a_day)), "meat": meat, "spice": spice,
    }
    out = _rows_fixed(week, **{f"_{n}_part": c for n, c in parts.items()})
    out = out.select("plan_id", *(F.col(f"_{n}_part" if n in parts else n).alias(n) for n in POINTS))
    return out.select("plan_id", *POINTS, _sum([points * F.col(p) for p, points in POINTS.items()]).alias("fitness"))


def validate(items: DataFrame, foods: DataFrame, kcal: float, targets: Targets, days: int, most_grams: float = 300) -> DataFrame:
    """(plan_id, energy_ok, bounds_ok, meat_ok, spice_ok, grams_ok, valid) by the strict rules: energy within 1 %, all minima and maxima, weekly limits, no more of a food a day than ``most_grams``."""
    week = totals(items, foods, ["calories", *targets], ["plan_id"])
    bounds = F.lit(True)
    for n, (low, high) in targets.items():
        bounds = bounds & (q(n) >= (low or 0) * days) & ((q(n) <= high * days) if high else F.lit(True))
    week = week.select("plan_id", (F.abs(F.col("calories") - kcal * days) <= 0.01 * kcal * days).alias("energy_ok"), bounds.alias("bounds_ok"))
    kinds = kind_scores(items, foods).select("plan_id", ((F.col("red") <= WEEKLY["red"][0]) & (F.col("processed") <= WEEKLY["processed"][0])).alias("meat_ok"), ((F.col("spices") <= WEEKLY["spice"][0]) & (F.col("herb") <= WEEKLY["herb"][0])).alias("spice_ok"))
    each = items.groupBy("plan_id", "day", "food_id").agg(F.sum("grams").alias("g")).groupBy("plan_id").agg((F.max("g") <= most_grams).alias("grams_ok"))
    out = week.join(kinds, "plan_id").join(each, "plan_id")
    return out.withColumn("valid", F.col("energy_ok") & F.col("bounds_ok") & F.col("meat_ok") & F.col("spice_ok") & F.col("grams_ok"))


def density(kcal: str, amounts: Mapping[str, float]) -> Column:
    """Daily amounts covered per 100 kcal; 0 without energy."""
    share = _sum([F.coalesce(q(n), F.lit(0.0)) / rda for n, rda in amounts.items() if rda > 0])
    return F.when(q(kcal) > 0, share / q(kcal) * 100).otherwise(0.0)


def rarity(foods: DataFrame, kcal: str, minima: Mapping[str, float]) -> DataFrame:
    """(nutrient, rarity): log of 1 + the inverse of the mean share of the minimum that 100 kcal give, over foods above 10 kcal; 1 without a minimum, 10 without foods. One pass."""
    known = foods.where(q(kcal) > 10)
    means = known.agg(*(F.avg(F.coalesce(q(n), F.lit(0.0)) / (low or 1.0) / (q(kcal) / 100)).alias(n) for n, low in minima.items()))
    value = lambda n, low: F.coalesce(F.log1p(1 / F.greatest(q(n), F.lit(0.001))), F.lit(10.0)) if low > 0 else F.lit(1.0)
    return means.select(F.inline(F.array(*(F.struct(F.lit(n).alias("nutrient"), value(n, low).alias("rarity")) for n, low in minima.items()))))


def buckets(foods: DataFrame, kcal: str, minima: Mapping[str, float], rare: Mapping[str, float]) -> DataFrame:
    """(food_id, nutrient, primary, secondary): the nutrient to whose minimum a food of 10 kcal or more gives most, weighted by rarity, the first of equals; and the sum of the others."""
    live = {n: low for n, low in minima.items() if low > 0}
    value = {n: F.coalesce(q(n), F.lit(0.0)) / low * rare.get(n, 1.0) for n, low in live.items()}
    best = F.greatest(*value.values())
    name = reduce(lambda rest, n: F.when(value[n] == best, n).otherwise(rest), reversed(list(live)), F.lit(None).cast("string"))
    out = foods.where(q(kcal) >= 10).select("food_id", F.when(best > 0, name).alias("nutrient"), F.when(best > 0, best).otherwise(0.0).alias("primary"), _sum(list(value.values())).alias("_all"))
    return out.select("food_id", "nutrient", "primary", (F.col("_all") - F.col("primary")).alias("secondary"))


def infeasibility(foods: DataFrame, kcal_col: str, minima: Mapping[str, float], budget: float, slack: float = 0.20) -> DataFrame:
    """(nutrient, best_food, density, kcal_needed, percent, rank): what each minimum costs with its densest food, most demanding first. One pass over the foods."""
    rich = foods.where(q(kcal_col) > 0)
    best = rich.agg(*(F.max(F.struct((F.coalesce(q(n), F.lit(0.0)) / q(kcal_col)).alias("d"), (-F.col("food_id")).alias("id"))).alias(n) for n in minima))
    each = best.select(F.inline(F.array(*(F.struct(F.lit(n).alias("nutrient"), (-F.col(f"`{n}`.id")).alias("best_food"), F.col(f"`{n}`.d").alias("density"), F.lit(float(low)).alias("low")) for n, low in minima.items()))))
    need = F.when(F.col("density") > 0, F.col("low") * (1 - slack) / F.col("density"))
    out = each.select("nutrient", "best_food", "density", need.alias("kcal_needed"), (100.0 * need / budget).alias("percent"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_first("percent"), "nutrient")))
