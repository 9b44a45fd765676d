"""Energy and nutrient targets of user profiles."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import first_of
from ..functions.numbers import col, round_even
from ..operators.matching import in_range, small

# Multipliers of the basal rate by activity.
ACTIVITY = {"sedentary": 1.2, "lightly_active": 1.375, "moderately_active": 1.55, "active": 1.55, "very_active": 1.725, "super_active": 1.9, "athlete": 1.9}
# Energy added for a goal, by its names.
GOALS = {"muscle_gain": 300.0, "build": 300.0, "bulk": 300.0, "fat_loss": -500.0, "cut": -500.0, "lose_weight": -500.0}
SERVICE_GOALS = {"muscle_gain": 250.0, "loss": -500.0}
# The table's own key for a goal.
GOAL_KEYS = {"muscle_gain": "athlete_strength", "athletic_performance": "athlete_endurance"}
# Nutrients too rarely known to be constraints.
SUPPLEMENTED = ["Vitamin D (mcg)", "Iodine (mcg)", "Biotin (mcg)", "Molybdenum (mcg)"]


def basal_rate(weight: Column | str, height: Column | str, age: Column | str, gender: Column | str, strict: bool = False) -> Column:
    """Mifflin-St Jeor. Any gender but male counts as female; ``strict``: others give null."""
    base = 10.0 * col(weight) + 6.25 * col(height) - 5.0 * col(age)
    sex = F.lower(col(gender))
    other = F.lit(None).cast("double") if strict else base - 161
    return F.when(sex == "male", base + 5).when(sex == "female", base - 161).otherwise(other)


def activity_factor(level: Column | str, table: Mapping[str, float] = ACTIVITY, otherwise: float | None = 1.2) -> Column:
    return first_of([(col(level) == k, v) for k, v in table.items()], F.lit(otherwise).cast("double"))


def goal_change(goal: Column | str, table: Mapping[str, float] = GOALS) -> Column:
    return first_of([(col(goal) == k, v) for k, v in table.items()], 0.0)


def daily_energy(weight: str, height: str, age: str, gender: str, level: str, goal: str) -> Column:
    """Energy for a profile and goal, rounded half to even."""
    return F.rint(basal_rate(weight, height, age, gender) * activity_factor(level) + goal_change(goal))


def weekly_activity(schedule: DataFrame, mets: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, tdee, multiplier): 1.2 times the basal rate plus a seventh of the week's exercise.

    Schedule: (id, activity, minutes, intensity, frequency); mets: (activity, intensity, met), a small table; profiles: (id, weight, bmr). Unknown
    activities count nothing, unknown intensities as medium, a missing frequency as 1.
    """
    met = small(mets)
    medium = small(mets.where("intensity = 'medium'").select("activity", F.col("met").alias("medium")))
    known = schedule.join(medium, "activity").join(met, ["activity", "intensity"], "left")
    each = F.coalesce("met", "medium") * F.col("minutes") / 60.0 * F.coalesce(F.col("frequency").cast("double"), F.lit(1.0))
    week = known.groupBy("id").agg(F.sum(each).alias("per_kg"))
    tdee = F.col("bmr") * 1.2 + F.coalesce(F.col("per_kg") * F.col("weight"), F.lit(0.0)) / 7.0
    return profiles.join(week, "id", "left").select("id", tdee.alias("tdee"), (tdee / F.col("bmr")).alias("multiplier"))


def macro_split(kcal: Column | str, weight: Column | str) -> dict[str, Column]:
    """2 g protein a kg, a quarter of the energy as fat, the rest as carbohydrate."""
    protein, fat = 2.0 * col(weight), 0.25 * col(kcal) / 9.0
    return {"protein": protein, "fat": fat, "carbohydrate": (col(kcal) - protein * 4.0 - fat * 9.0) / 4.0}


def age_bounds(text: str) -> tuple[float, float | None] | None:
    """Years of "0-6 months", "1-3 years", "19+ years", "19-50" or "51+"; None for other keys."""
    number, _, unit = text.partition(" ")
    scale = 12.0 if unit.startswith("month") else 1.0
    try:
        if number.endswith("+"):
            return float(number[:-1]) / scale, None
        low, high = number.split("-")
        return float(low) / scale, float(high) / scale
    except ValueError:
        return None


def range_table(spark: SparkSession, table: Mapping[str, Mapping[str, Mapping[str, Mapping[str, object]]]]) -> DataFrame:
    """(ord, kind, nutrient, key, gender, low, high, min, max) from a nested table kind > nutrient > age range or goal key > gender or all > min, max.

    A small dimension table; ``low`` and ``high`` are null for goal keys. Where a range has the gender and ``all``, the gender goes first.
    """
    rows = []
    for kind, nutrients in table.items():
        for nutrient, ranges in nutrients.items():
            for key, values in ranges.items():
                bounds = age_bounds(key)
                for gender, v in sorted(values.items(), key=lambda kv: kv[0] == "all"):
                    low, high = bounds or (None, None)
                    rows.append((len(rows), kind, nutrient, None if bounds else key, gender, low, high, *(None if v.get(b) is None else float(v[b]) for b in ("min", "max"))))
    return spark.createDataFrame(rows, "ord int, kind string, nutrient string, key string, gender string, low double, high double, min double, max double")


def load_tables(spark: SparkSession, path: str) -> dict:
    """The nested tables of a JSON file, by whatever file system Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def micronutrients(profiles: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, nutrient, min, max) of each profile (id, age, gender, goal) and nutrient: the goal's own values, else those of the first range in the table that holds the age; nulls if none."""
    keys = first_of([(F.col("goal") == g, k) for g, k in GOAL_KEYS.items()], F.lit(None).cast("string"))
    people = profiles.select("id", "age", F.lower("gender").alias("_g"), keys.alias("_key"))
    fits = (F.col("gender") == F.col("_g")) | (F.col("gender") == "all")
    aged = in_range(people, "age", ranges.where("key is null"), ["nutrient"], lambda r: (r("gender") == F.col("_g")) | (r("gender") == "all")).select("id", "nutrient", "min", "max")
    goal = people.join(small(ranges.where("key is not null")), (F.col("key") == F.col("_key")) & fits)
    goal = goal.groupBy("id", "nutrient").agg(F.min_by(F.struct("min", "max"), "ord").alias("own"))
    every = people.select("id").join(small(ranges.select("nutrient").distinct()))
    out = every.join(goal, ["id", "nutrient"], "left").join(aged, ["id", "nutrient"], "left")
    pick = lambda c: F.when(F.col("own").isNotNull(), F.col(f"own.{c}")).otherwise(F.col(c)).alias(c)
    return out.select("id", "nutrient", pick("min"), pick("max"))


def limits(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, nutrient, min, max), rounded to 2 digits.

    Profiles: (id, age, gender, weight, kcal, level, goal). Rules: (ord, nutrient, strategy, genders, low, high, min, max, build, active, safe, least_grams), a small table of
    strategies absolute, bodyweight (per kg; for protein the building or active optimum where the goal or level asks for it; the safe maximum where there is none) and percent_calories (9 kcal a g of fat,
    else 4; not below ``least_grams``). The first rule of a nutrient that fits gender and age counts.
    """
    hit = in_range(profiles, "age", rules, ["nutrient"], lambda r: F.array_contains(F.split(F.lower(r("genders")), r"\|"), F.lower("gender")))
    protein = F.lower("nutrient").contains("protein")
    build = protein & F.col("goal").isin("muscle_gain", "build")
    active = protein & F.col("level").isin("active", "very_active")
    low = F.when(build, F.coalesce("build", "min")).when(active, F.coalesce("active", "min")).otherwise(F.col("min"))
    grams = lambda c: F.col("kcal") * (c / 100.0) / F.when(F.lower("nutrient").contains("fat"), 9.0).otherwise(4.0)
    by_weight = F.col("strategy") == "bodyweight"
    by_energy = F.col("strategy") == "percent_calories"
    share = F.when(F.col("min").isNotNull(), F.greatest(grams(F.col("min")), F.coalesce("least_grams", F.lit(0.0))))
    least = F.when(by_weight, low * F.col("weight")).when(by_energy, share).otherwise(F.col("min"))
    most = F.when(by_weight, F.coalesce(F.col("max") * F.col("weight"), F.col("safe") * F.col("weight"))).when(by_energy, grams(F.col("max"))).otherwise(F.col("max"))
    return hit.select("id", "nutrient", round_even(least).alias("min"), round_even(most).alias("max"))


def ranges_for(profiles: DataFrame, micros: DataFrame) -> DataFrame:
    """(id, nutrient, min, max) for a profile (id, kcal, protein, fat, carbohydrate): energy within 5 %, macros within 10 %, and the micronutrients as they are."""
    around = lambda name, c, by: F.struct(F.lit(name).alias("nutrient"), (F.col(c) * (1 - by)).alias("min"), (F.col(c) * (1 + by)).alias("max"))
    own = profiles.select("id", F.inline(F.array(around("calories", "kcal", 0.05), *(around(m, m, 0.10) for m in ("protein", "fat", "carbohydrate")))))
    return own.unionByName(micros.select("id", "nutrient", "min", "max"))


def constraints(ranges: DataFrame, supplemented: Sequence[str] = SUPPLEMENTED) -> tuple[DataFrame, DataFrame]:
    """(constraints, supplements): ranges that a plan must keep, and those left to supplements."""
    left_out = F.col("nutrient").isin(list(supplemented))
    return ranges.where(~left_out & (F.coalesce("min", "max").isNotNull())), ranges.where(left_out)
