"""Queries of targets, plan scores and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import cluster, ranking
from ..plans import genetic, milp, scoring, targets
from .base import query

DAYS = 7
NUTRIENTS = ["calories", "protein", "fat", "carbohydrate", "Iron (mg)", "Calcium (mg)"]
# Odd targets: sums of the data don't fall on their bounds, where the order of a sum's terms would decide.
TARGETS = {"protein": (60.37, 401.3), "fat": (50.71, None), "carbohydrate": (101.33, 303.7), "Iron (mg)": (17.9337, 45.17), "Calcium (mg)": (1003.71, 2503.3)}
KCAL = 2003.37
PER_100 = 'kcal as calories, protein, fat, carbs as carbohydrate, fiber as "Iron (mg)", sodium as "Calcium (mg)"'
MENU = f"menu as (select food_id, name, {PER_100} from foods)"
SUMS = ", ".join(f'sum(coalesce("{n}", 0) * grams / 100) as "{n}"' for n in NUTRIENTS)


def menu(t):
    return t.foods.select("food_id", "name", F.col("kcal").alias("calories"), "protein", "fat", F.col("carbs").alias("carbohydrate"), F.col("fiber").alias("Iron (mg)"), F.col("sodium").alias("Calcium (mg)"))


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


# Targets

BMR = "10 * weight + 6.25 * height - 5 * age + case when gender = 'male' then 5 else -161 end"
FACTOR = "case level when 'sedentary' then 1.2E0 when 'lightly_active' then 1.375E0 when 'moderately_active' then 1.55E0 when 'active' then 1.55E0 when 'very_active' then 1.725E0 when 'super_active' then 1.9E0 when 'athlete' then 1.9E0 else 1.2E0 end"


@query(f"select id, round({BMR}, 6) as bmr, {FACTOR} as factor, round_even(({BMR}) * ({FACTOR}) + case goal when 'muscle_gain' then 300 when 'fat_loss' then -500 else 0 end, 0) as kcal, round(({BMR}) * 1.2E0 - 2 * weight * 4, 6) as rest from profiles")
def tdee_profiles(t):
    bmr = targets.basal_rate("weight", "height", "age", "gender")
    energy = targets.daily_energy("weight", "height", "age", "gender", "level", "goal")
    split = targets.macro_split(bmr * 1.2, "weight")
    return t.profiles.select("id", F.round(bmr, 6).alias("bmr"), targets.activity_factor("level").alias("factor"), energy.alias("kcal"), F.round(split["fat"] * 9 + split["carbohydrate"] * 4, 6).alias("rest"))


METS = "mets(activity, intensity, met) as (values ('walk', 'low', 2.5E0), ('walk', 'medium', 3.5E0), ('run', 'medium', 11.5E0), ('run', 'high', 16.0E0))"
SCHEDULE = "schedule as (select user_id % 100 as id, case event_type when 'click' then 'walk' when 'view' then 'run' else 'swim' end as activity, value as minutes, case event_id % 3 when 0 then 'low' when 1 then 'high' else 'medium' end as intensity, case when event_id % 2 = 0 then event_id % 5 end as frequency from events)"


@query(f"""select id, round(bmr * 1.2E0 + coalesce(per_kg * weight, 0) / 7, 6) as tdee, round((bmr * 1.2E0 + coalesce(per_kg * weight, 0) / 7) / bmr, 9) as multiplier from (select id, weight, {BMR} as bmr from profiles)
    left join (select id, sum(coalesce(m.met, d.met) * minutes / 60 * coalesce(frequency, 1)) as per_kg from schedule s join mets d on d.activity = s.activity and d.intensity = 'medium' left join mets m on m.activity = s.activity and m.intensity = s.intensity group by id) using (id)""", f"{METS}, {SCHEDULE}")
def tdee_advanced(t):
    mets = t.spark.createDataFrame([("walk", "low", 2.5), ("walk", "medium", 3.5), ("run", "medium", 11.5), ("run", "high", 16.0)], "activity string, intensity string, met double")
    schedule = t.events.selectExpr("user_id % 100 as id", "case event_type when 'click' then 'walk' when 'view' then 'run' else 'swim' end as activity", "value as minutes", "case event_id % 3 when 0 then 'low' when 1 then 'high' else 'medium' end as intensity", "case when event_id % 2 = 0 then event_id % 5 end as frequency")
    out = targets.weekly_activity(schedule, mets, t.profiles.select("id", "weight", targets.basal_rate("weight", "height", "age", "gender").alias("bmr")))
    return out.select("id", F.round("tdee", 6).alias("tdee"), F.round("multiplier", 9).alias("multiplier"))


RDA = {
    "minerals": {"Iron (mg)": {"0-6 months": {"all": {"min": 0.27, "max": 40}}, "1-18 years": {"all": {"min": 9, "max": 40}}, "19-50 years": {"male": {"min": 8, "max": 45}, "female": {"min": 18, "max": 45}}, "51+ years": {"all": {"min": 8, "max": None}}, "athlete_strength": {"all": {"min": 20, "max": 45}}}},
    "other": {"Fiber (g)": {"1-70 years": {"male": {"min": 38, "max": None}, "female": {"min": 25, "max": None}}, "70+ years": {"all": {"min": 30, "max": None}}}},
}


def _rda_rows() -> str:
    rows = []
    for kind, nutrients in RDA.items():
        for nutrient, ranges in nutrients.items():
            for key, values in ranges.items():
                bounds = targets.age_bounds(key)
                for gender, v in values.items():
                    low, high = bounds or (None, None)
                    cell = lambda x: "cast(null as double)" if x is None else f"{float(x)!r}::double"
                    rows.append(f"({len(rows)}, '{kind}', '{nutrient}', {'null' if bounds else repr(key)}, '{gender}', {cell(low)}, {cell(high)}, {cell(v['min'])}, {cell(v['max'])})")
    return "rda(ord, kind, nutrient, key, gender, low, high, lo, hi) as (values " + ", ".join(rows) + ")"


@query("""select p.id, n.nutrient, case when g.id is not null then g.lo else a.lo end as min, case when g.id is not null then g.hi else a.hi end as max from profiles p cross join (select distinct nutrient from rda) n
    left join (select p.id, nutrient, arg_min(lo, ord) as lo, max(hi) as hi from profiles p join rda on key = case goal when 'muscle_gain' then 'athlete_strength' when 'athletic_performance' then 'athlete_endurance' end and rda.gender in (p.gender, 'all') group by 1, 2) g on g.id = p.id and g.nutrient = n.nutrient
    left join (select * from (select p.id, nutrient, lo, hi, row_number() over (partition by p.id, nutrient order by ord) as r from profiles p join rda on key is null and p.age >= low and (high is null or p.age <= high) and rda.gender in (p.gender, 'all')) where r = 1) a on a.id = p.id and a.nutrient = n.nutrient""", _rda_rows())
def rda_range_lookup(t):
    return targets.micronutrients(t.profiles, targets.range_table(t.spark, RDA))


RULES = [
    (0, "protein", "bodyweight", "male|female", 19.0, 50.0, 0.8, None, 2.2, 1.6, 3.0, None), (1, "protein", "bodyweight", "male|female", 51.0, 150.0, 1.0, 2.0, None, None, None, None),
    (2, "fat", "percent_calories", "male|female", 0.0, 150.0, 20.0, 35.0, None, None, None, None), (3, "carbohydrate", "percent_calories", "male|female", 19.0, 150.0, 45.0, 65.0, None, None, None, 130.0),
    (4, "Iron (mg)", "absolute", "male", 19.0, 50.0, 8.0, 45.0, None, None, None, None), (5, "Iron (mg)", "absolute", "female", 19.0, 50.0, 18.0, 45.0, None, None, None, None), (6, "Vitamin C (mg)", "absolute", "male|female", 1.0, 150.0, 90.0, None, None, None, None, None),
]
RULES_SQL = "rules(ord, nutrient, strategy, genders, low, high, lo, hi, build, active, safe, least_grams) as (values " + ", ".join("(" + ", ".join("cast(null as double)" if x is None else f"{x!r}::double" if isinstance(x, float) else repr(x) for x in r) + ")" for r in RULES) + ")"


@query(f"""select id, nutrient, round_even(case strategy when 'bodyweight' then case when nutrient = 'protein' and goal = 'muscle_gain' then coalesce(build, lo) when nutrient = 'protein' and level = 'very_active' then coalesce(active, lo) else lo end * weight
      when 'percent_calories' then greatest(kcal * (lo / 100) / case when nutrient = 'fat' then 9.0 else 4.0 end, coalesce(least_grams, 0)) else lo end * 100, 0) / 100 as min,
    round_even(case strategy when 'bodyweight' then coalesce(hi, safe) * weight when 'percent_calories' then kcal * (hi / 100) / case when nutrient = 'fat' then 9.0 else 4.0 end else hi end * 100, 0) / 100 as max
    from (select p.*, r.*, 1500.0E0 + p.id % 1000 as kcal, row_number() over (partition by p.id, r.nutrient order by r.ord) as k from profiles p join rules r on p.age >= low and p.age <= high and contains('|' || genders || '|', '|' || p.gender || '|')) where k = 1""", RULES_SQL)
def limits_by_strategy(t):
    rules = t.spark.createDataFrame(RULES, "ord int, nutrient string, strategy string, genders string, low double, high double, min double, max double, build double, active double, safe double, least_grams double")
    return targets.limits(t.profiles.withColumn("kcal", F.lit(1500.0) + F.col("id") % 1000), rules)


@query("""select id, nutrient, round(lo, 6) as min, round(hi, 6) as max from (select id, 'calories' as nutrient, kcal * 0.95E0 as lo, kcal * 1.05E0 as hi from (select id, 1500.0E0 + id % 1000 as kcal from profiles) union all select id, 'protein', weight * 2 * 0.9E0, weight * 2 * 1.1E0 from profiles
    union all select id, 'fat', kcal * 0.25E0 / 9 * 0.9E0, kcal * 0.25E0 / 9 * 1.1E0 from (select id, 1500.0E0 + id % 1000 as kcal from profiles) union all select id, 'carbohydrate', c * 0.9E0, c * 1.1E0 from (select id, (1500.0E0 + id % 1000 - weight * 8 - (1500.0E0 + id % 1000) * 0.25E0) / 4 as c from profiles)
    union all select id, 'Iron (mg)', 8.0, 45.0 from profiles)""")
def calculate_ranges(t):
    people = t.profiles.select("id", "weight", (F.lit(1500.0) + F.col("id") % 1000).alias("kcal"))
    people = people.select("id", "kcal", *(c.alias(n) for n, c in targets.macro_split("kcal", "weight").items()))
    micros = people.select("id", F.lit("Iron (mg)").alias("nutrient"), F.lit(8.0).alias("min"), F.lit(45.0).alias("max")).unionByName(people.select("id", F.lit("Vitamin D (mcg)").alias("nutrient"), F.lit(15.0).alias("min"), F.lit(100.0).alias("max")))
    kept, _ = targets.constraints(targets.ranges_for(people, micros))
    return rounded(kept, ["min", "max"])


# Plans


@query(f'select plan_id, day, {", ".join(f"""round("{n}", 4) as "{n}\"""" for n in NUTRIENTS)} from (select plan_id, day, {SUMS} from items join menu using (food_id) group by plan_id, day)', MENU)
def plan_totals(t):
    return rounded(scoring.totals(t.items, menu(t), NUTRIENTS), NUTRIENTS, 4)


def _status(n: str, low: float | None, high: float | None, slack: float) -> str:
    under, over = f'"{n}" < {low}::double * {1 - slack}::double' if low else "false", f'"{n}" > {high}::double * {1 + slack}::double' if high else "false"
    error = f"case when {under} then round(({low or 0}::double - \"{n}\") / {low or 1}::double * 100, 1) when {over} then round((\"{n}\" - {high or 0}::double) / {high or 1}::double * 100, 1) end"
    return f"select plan_id, '{n}' as nutrient, \"{n}\" as actual, case when {under} then 'below_min' when {over} then 'above_max' else 'in_range' end as status, {error} as error from daily"


DAILY = f"daily as (select plan_id, {', '.join(f'round(\"{n}\" / 7, 4) as \"{n}\"' for n in NUTRIENTS)} from (select plan_id, {SUMS} from items join menu using (food_id) group by plan_id))"
GOALS = {"calories": (KCAL * 0.95, KCAL * 1.05, 0.0)} | {n: (*b, 0.2) for n, b in TARGETS.items()}


@query(" union all ".join(_status(n, *g) for n, g in GOALS.items()), f"{MENU}, {DAILY}")
def plan_compliance(t):
    daily = scoring.daily_average(t.items, menu(t), NUTRIENTS, DAYS, 4)
    bound = lambda x: F.lit(None if x is None else float(x)).cast("double")
    each = F.array(*(F.struct(F.lit(n).alias("nutrient"), F.col(f"`{n}`").alias("actual"), bound(lo).alias("lo"), bound(hi).alias("hi"), F.lit(s).alias("slack")) for n, (lo, hi, s) in GOALS.items()))
    long = daily.select("plan_id", F.inline(each))
    strict, error0 = classify.compliance("actual", "lo", "hi", 0.0)
    loose, error1 = classify.compliance("actual", "lo", "hi", 0.2)
    tight = F.col("slack") == 0
    return long.select("plan_id", "nutrient", "actual", F.when(tight, strict).otherwise(loose).alias("status"), F.when(tight, error0).otherwise(error1).alias("error"))


@query("select food_id, case when kcal < 100 - 0.1 then 'LOW' when kcal > 500 + 0.1 then 'HIGH' else 'OK' end as status from foods")
def bound_status(t):
    return t.foods.select("food_id", classify.bound_status("kcal", F.lit(100.0), F.lit(500.0)).alias("status"))


@query("select plan_id, name, round(sum(grams), 1) as grams from items join menu using (food_id) group by plan_id, name", MENU)
def shopping_list(t):
    return scoring.shopping_list(t.items, menu(t))


TRIO = """slots as (select plan_id, day, food_id, row_number() over (partition by plan_id, day order by food_id, order_id, slot) as s from items),
    trio as (select a.plan_id, a.food_id as x, b.food_id as y, c.food_id as z, count(*) as n from slots a join slots b on a.plan_id = b.plan_id and a.day = b.day and a.s < b.s join slots c on a.plan_id = c.plan_id and a.day = c.day and b.s < c.s group by 1, 2, 3, 4)"""


@query("select p.plan_id, cast(coalesce(v, 0) as bigint) as violations from (select distinct plan_id from items) p left join (select plan_id, sum(greatest(0, n - 1)) as v from trio group by plan_id) t on t.plan_id = p.plan_id", TRIO)
def trio_variety(t):
    return scoring.trios(t.items, 1)


KINDS = "select plan_id, coalesce(sum(grams) filter (where meat = 'red'), 0) as red, coalesce(sum(grams) filter (where meat = 'processed'), 0) as processed, coalesce(sum(grams) filter (where spice = 'spice'), 0) as spices, coalesce(sum(grams) filter (where spice = 'herb'), 0) as herb from items join kinds using (food_id) group by plan_id"


def _kinds_cte() -> str:
    from ..functions import fixed
    from .names import holds

    return f"kinds as (select food_id, case when {holds('n', fixed.PROCESSED_MEAT)} then 'processed' when {holds('n', fixed.RED_MEAT)} then 'red' end as meat, case when {holds('n', fixed.DRIED_SPICE)} then 'spice' when {holds('n', fixed.FRESH_HERB)} then 'herb' end as spice, {holds('n', [*fixed.DRIED_SPICE, *fixed.FRESH_HERB, *fixed.SAUCE])} as seasoning from (select food_id, lower(name) as n from foods))"


MEAT = "greatest(0, 1 - least(0.5, 0.5 * greatest(0, (red - 500) / 500)) - least(0.5, 0.5 * greatest(0, (processed - 70) / 70)))"
SPICE = "greatest(0, 1 - least(0.5, 0.3 * greatest(0, (spices - 30) / 30)) - least(0.5, 0.3 * greatest(0, (herb - 100) / 100)))"
SEASONING = "select plan_id, avg(case when n >= 3 then 1.0 else 0.0 end) as seasoning from (select plan_id, day, count(*) filter (where seasoning) as n from items left join kinds using (food_id) group by plan_id, day) group by plan_id"


@query(f"select *, round({MEAT}, 9) as meat_score, round({SPICE}, 9) as spice_score from ({KINDS})", _kinds_cte())
def kind_limits(t):
    return rounded(scoring.kind_scores(t.items, menu(t)), ["meat_score", "spice_score"], 9)


@query(f"select plan_id, round(seasoning, 9) as seasoning from ({SEASONING})", _kinds_cte())
def seasoning_days(t):
    return rounded(scoring.seasoning_score(t.items, menu(t)), ["seasoning"], 9)


def _nutrient_sql() -> str:
    parts = [f"greatest(0, 1 - 2 * abs(1 - calories / {KCAL * DAYS}))"]
    for n, (low, high) in TARGETS.items():
        r = f'("{n}" / {low * DAYS})'
        s = f"case when {r} >= 1 then 1.0 when {r} >= 0.95 then 0.95 when {r} >= 0.9 then 0.85 when {r} >= 0.8 then 0.7 else 0.6 * {r} end"
        if high:
            s = f'case when "{n}" > {high * DAYS} then greatest(0, 1 - 10 * ("{n}" / {high * DAYS} - 1)) else {s} end'
        parts += [f"cast({s} as double)"] * (2 if n in scoring.PRIORITY else 1)
    return f"({' + '.join(parts)}) / {len(parts)}"


def _deviation_sql(n: str, target: float) -> str:
    width, steep = scoring.TIERS[1 if n in scoring.TIER_1 else 3 if n in scoring.TIER_3 else 2]
    d = f'(abs("{n}" - {target}) / {target})'
    return f"case when {d} <= 0 then 1.0 else greatest(0.01, 1 - 0.9 * (exp(least(700, {steep} * {d} / {width})) - 1) / (exp({steep}) - 1)) end"


def _balance_sql() -> str:
    goal = {"calories": KCAL} | {m: TARGETS[m][0] for m in ("protein", "fat", "carbohydrate")}
    macros = " + ".join(f"cast({_deviation_sql(n, v)} as double)" for n, v in goal.items())
    micro = lambda n: f'(abs("{n}" - {TARGETS[n][0]}) / {TARGETS[n][0]})'
    micros = " + ".join(f"case when {micro(n)} <= 0.3 then 1.0 when {micro(n)} <= 0.5 then 0.8 when {micro(n)} <= 0.7 then 0.5 else 0.2 end" for n in ("Iron (mg)", "Calcium (mg)"))
    return f"select plan_id, case when count(*) > 1 then avg(({macros}) / {len(goal)}) else 1.0 end as macros, case when count(*) > 1 then avg(cast({micros} as double) / 2) else 1.0 end as micros from days group by plan_id"


FITNESS_PARTS = f"{MENU}, {TRIO}, {_kinds_cte()}, days as (select plan_id, day, {SUMS} from items join menu using (food_id) group by plan_id, day)"
FITNESS_SQL = f"""select *, round(20 * n + 25 * a + 10 * i + 10 * v + 5 * u + 10 * m + 5 * s + 15 * e, 6) as fitness from
    (select plan_id, n, a, i, v, u, m, s, e from (select plan_id, {_nutrient_sql()} as n from (select plan_id, {', '.join(f'sum("{n}") as "{n}"' for n in NUTRIENTS)} from days group by plan_id))
     join (select plan_id, macros as a, micros as i from ({_balance_sql()})) using (plan_id)
     join (select p.plan_id, greatest(0, 1 - 0.1 * coalesce(v, 0)) as v from (select distinct plan_id from items) p left join (select plan_id, sum(greatest(0, n - 2)) as v from trio group by plan_id) t on t.plan_id = p.plan_id) using (plan_id)
     join (select plan_id, least(1, count(distinct food_id) / 12.0) as u from items group by plan_id) using (plan_id)
     join (select plan_id, {MEAT} as m, {SPICE} as s from ({KINDS})) using (plan_id) join (select plan_id, seasoning as e from ({SEASONING})) using (plan_id))"""


@query(f"select plan_id, round(n, 6) as nutrients, round(a, 6) as macros, round(i, 6) as micros, cast(round(v, 6) as double) as variety, cast(round(u, 6) as double) as unique_foods, round(m, 6) as meat, round(s, 6) as spice, round(e, 6) as seasoning, fitness from ({FITNESS_SQL})", FITNESS_PARTS)
def plan_fitness(t):
    out = scoring.fitness(t.items, menu(t), KCAL, TARGETS, DAYS, 6)
    return rounded(out, [*scoring.POINTS, "fitness"]).withColumnRenamed("unique", "unique_foods")


@query(f"""select plan_id, abs(calories - {KCAL * DAYS}) <= {0.01 * KCAL * DAYS} as energy_ok, {' and '.join(f'"{n}" >= {lo * DAYS}' + (f' and "{n}" <= {hi * DAYS}' if hi else '') for n, (lo, hi) in TARGETS.items())} as bounds_ok, red <= 500 and processed <= 70 as meat_ok, spices <= 30 and herb <= 100 as spice_ok, g <= 300 as grams_ok,
    energy_ok and bounds_ok and meat_ok and spice_ok and grams_ok as valid from (select plan_id, {SUMS} from items join menu using (food_id) group by plan_id) join ({KINDS}) using (plan_id) join (select plan_id, max(g) as g from (select plan_id, day, food_id, sum(grams) as g from items group by 1, 2, 3) group by 1) using (plan_id)""", f"{MENU}, {_kinds_cte()}")
def plan_validator(t):
    return scoring.validate(t.items, menu(t), KCAL, TARGETS, DAYS)


MINIMA = {n: low for n, (low, _) in TARGETS.items()} | {"calories": 0.0}


@query("select nutrient, round(r, 9) as rarity from (" + " union all ".join(f"select '{n}' as nutrient, ln(1 + 1 / greatest(avg(coalesce(\"{n}\", 0) / {low} / (calories / 100)), 0.001)) as r from menu where calories > 10" if low else f"select '{n}', 1.0" for n, low in MINIMA.items()) + ")", MENU)
def nutrient_rarity(t):
    return rounded(scoring.rarity(menu(t), "calories", MINIMA), ["rarity"], 9)


RARE = {"protein": 1.5, "fat": 2.0, "carbohydrate": 1.0, "Iron (mg)": 3.0, "Calcium (mg)": 2.5}
VALUES = {n: f'coalesce("{n}", 0) / {low} * {RARE[n]}' for n, low in MINIMA.items() if low}


@query(f"select food_id, case when best > 0 then case {' '.join(f'''when {v} = best then '{n}' ''' for n, v in VALUES.items())} end end as nutrient, round(best, 9) as primary, round(total - best, 9) as secondary from (select *, greatest({', '.join(VALUES.values())}) as best, {' + '.join(VALUES.values())} as total from menu where calories >= 10)".replace("as primary", 'as "primary"'), MENU)
def nutrient_buckets(t):
    return rounded(scoring.buckets(menu(t), "calories", MINIMA, RARE), ["primary", "secondary"], 9)


@query("select food_id, round(case when calories > 0 then (coalesce(protein, 0) / 50 + coalesce(fat, 0) / 65 + coalesce(\"Iron (mg)\", 0) / 8) / calories * 100 else 0 end, 9) as density from menu", MENU)
def nutrient_density(t):
    return menu(t).select("food_id", F.round(scoring.density("calories", {"protein": 50.0, "fat": 65.0, "Iron (mg)": 8.0}), 9).alias("density"))


@query("select nutrient, food_id as best_food, round(d, 9) as density, round(need, 6) as kcal_needed, round(100 * need / 2003.37, 6) as percent, cast(row_number() over (order by need desc, nutrient) as integer) as rank from (select *, case when d > 0 then low * 0.8 / d end as need from (" + " union all ".join(f"(select '{n}' as nutrient, food_id, coalesce(\"{n}\", 0) / calories as d, {low} as low from menu where calories > 0 order by d desc, food_id limit 1)" for n, low in MINIMA.items() if low) + "))", MENU)
def infeasibility_analysis(t):
    out = scoring.infeasibility(menu(t), "calories", {n: low for n, low in MINIMA.items() if low}, KCAL)
    return rounded(rounded(out, ["density"], 9), ["kcal_needed", "percent"])


# Clusters and searches: their order decides, so SQL doesn't express them; tests hold them against plain versions.


@query()
def leader_cluster_10pct(t):
    return cluster.by_tolerance(t.foods, ["p_name", "p_type"], "food_id", ["kcal", "protein", "fat"], "kcal")


@query()
def spelling_dedup_93(t):
    return cluster.by_spelling(t.foods.where("name is not null"), [text.spelling_block("category", "name")], "food_id", "p_name", 93)


@query()
def taxonomy_85(t):
    return cluster.by_taxonomy(t.foods, [F.col("p_type"), F.col("p_brand")], "food_id", "p_name", ["kcal", "protein"])


@query()
def reference_merge_80(t):
    return cluster.by_spelling(t.foods, [F.col("p_type"), F.col("category")], "food_id", "p_name", 80, [("p_name", True)])


@query()
def agglomerative_cosine(t):
    return cluster.by_meaning(t.embeddings, [F.col("label")], "vec_id", "embedding", 0.6)


@query()
def agglomerative_buckets(t):
    rows = t.embeddings.select("vec_id", "embedding").join(t.foods.select(F.col("food_id").alias("vec_id"), "kcal", "protein"), "vec_id", "left")
    return cluster.by_meaning(rows, [text.nutrition_bucket("kcal", "protein")], "vec_id", "embedding", 0.10)


def candidates(t, per_nutrient: int = 30, most: int = 500):
    """Named foods of energy: half of them the best sources a kcal, which alone may have too little energy for a plan, half those of most energy, richest in nutrients first."""
    rich = {n: low for n, low in MINIMA.items() if low}
    named = menu(t).where("name <> '' and calories > 0")
    dense = ranking.best_sources(named, "food_id", "calories", rich, per_nutrient, most // 2).select(F.col("id").alias("food_id"))
    share = sum((F.least(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) / low, F.lit(1.0)) for n, low in rich.items()), F.lit(0.0))
    filling = named.join(dense, "food_id", "left_anti").orderBy(F.desc(F.floor(F.col("calories") / 100)), F.desc(share), "food_id").limit(most - most // 2).select("food_id")
    return named.join(dense.unionByName(filling), "food_id", "left_semi")


@query()
def ga_islands(t):
    return genetic.search(candidates(t), KCAL, TARGETS, islands=4, population=60, generations=100)


@query()
def milp_diet(t):
    people = t.profiles.select(F.col("id").alias("profile_id"), (F.lit(1800.0) + 100 * (F.col("id") % 4)).alias("kcal"))
    return milp.plan(candidates(t, most=100), people, TARGETS, nodes=300)
