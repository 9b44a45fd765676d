"""The driver's tables in the roles of the library's: foods, products, plan items, profiles. The same in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names, categories and brands that parts take turns in, so string operators meet food texts on whole tables.
SAMPLES = [
    ("Heinz Baked Beans 400g", "baked beans", "Heinz|Tesco"), ("Tesco - Semi Skimmed Milk 2 Pints", "milks", "Tesco"), ("Coca Cola 1.5L", "Sodas", "Coca Cola"), ("Walkers Crisps 6 x 25g", "crisps", "Walkers"),
    ("Organic Eggs Free Range", "fr:oeufs", "Waitrose"), ("Cathedral City - Mature Cheddar 350g", "cheddar cheese", "Cathedral City"), ("Beef, ground, 80% lean, raw", "Beef Products", None), ("Apples, raw, with skin", "Fruits and Fruit Juices", ""),
    ("Strawberries, raw", "strawberries", None), ("Spices, paprika", "Spices and Herbs", None), ("Chicken breast, roasted", "Poultry Products", "Asda"), ("Whey Protein Powder 1 kg", "protein powders", "MyBrand"),
    ("Basil, fresh", "herbs", None), ("Soy sauce 150ml", "sauces", "Amoy|Kikkoman"), ("Lamb, liver, fried", "Lamb, Veal, and Game Products", None), ("Wholemeal Bread 800g", "Baked Products", "Hovis"),
    ("Rice, brown, cooked", "Cereal Grains and Pasta", None), ("Tomato soup, canned", "Soups, Sauces, and Gravies", "Heinz"), ("Smoked Bacon 300g", "bacon", "Tesco|Asda"), ("Almonds", "almonds", None),
    ("Salmon fillet, raw", "Finfish and Shellfish Products", "Lidl"), ("Chicken tikka masala ready meal", "ready meals", "Tesco"), ("Dark chocolate 100 g", "dark chocolates", "Lindt"), ("Legumes, mixed", "Pulses", None),
    ("Greek yogurt 500g", "yogurts", "Fage"), ("", "", ""), (None, None, None), ("Potatoes, boiled", "Vegetables", None),
    ("Curry powder", "spices", "Schwartz"), ("12 x 330ml Lager", "Beverages", "Heineken"), ("Milk, condensed", "Milk and milk products", "Nestle"), ("1 lb Butter", "butters", "Lurpak"),
    ("Pizza base", "pizzas", "Tesco"), ("Seeds, pumpkin, dried", "Nut and Seed Products", None), ("Champagne", "wines", "Moet"), ("Tesco Finest Beef Lasagne by Tesco 1.5 kg", "lasagnes", "Tesco|Finest"),
    ("Parsley, fresh", "herbs", None),
]


def _quoted(x: str | None) -> str:
    return "cast(null as varchar)" if x is None else "'" + x.replace("'", "''") + "'"


#: The parts' numbers as nutrients per 100 g; the text is the same in both engines.
FOOD_COLUMNS = """
    p_partkey as food_id, samples.name as name, samples.category as category, samples.brands as brands, p_name, p_brand, p_type,
    cast((p_partkey * 37) % 1000 as double) as kcal,
    case when p_partkey % 17 <> 0 then cast((p_partkey * 7) % 600 as double) / 10 end as protein,
    case when p_partkey % 13 <> 0 then cast((p_partkey * 11) % 500 as double) / 10 end as fat,
    case when p_partkey % 11 <> 0 then cast((p_partkey * 13) % 1050 as double) / 10 end as carbs,
    case when p_partkey % 5 <> 0 then cast((p_partkey * 3) % 120 as double) / 10 end as fiber,
    cast((p_partkey * 19) % 2500 as double) as sodium
"""
ITEM_COLUMNS = "o_custkey as plan_id, o_orderkey % 7 as day, l_linenumber as slot, l_orderkey as order_id, l_partkey as food_id, l_quantity * 5 as grams"
PROFILE_COLUMNS = """
    c_custkey as id, cast(c_custkey % 90 as double) + 0.5 as age, case when c_custkey % 2 = 0 then 'male' else 'female' end as gender,
    50.0E0 + c_custkey % 60 as weight, 150.0E0 + c_custkey % 50 as height,
    case c_mktsegment when 'HOUSEHOLD' then 'sedentary' when 'MACHINERY' then 'lightly_active' when 'FURNITURE' then 'moderately_active' when 'BUILDING' then 'very_active' else 'unknown' end as level,
    case c_custkey % 4 when 0 then 'muscle_gain' when 1 then 'fat_loss' when 2 then 'athletic_performance' else 'general' end as goal
"""
_VALUES = ", ".join(f"({k}, {', '.join(map(_quoted, row))})" for k, row in enumerate(SAMPLES))
CTES = f"""
    samples(ord, name, category, brands) as (values {_VALUES}),
    foods as (select {FOOD_COLUMNS} from part join samples on samples.ord = p_partkey % {len(SAMPLES)}),
    items as (select {ITEM_COLUMNS} from lineitem join orders on l_orderkey = o_orderkey),
    profiles as (select {PROFILE_COLUMNS} from customer)
"""


class Tables:
    """Tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def foods(self) -> DataFrame:
        samples = self.spark.createDataFrame([(k, *row) for k, row in enumerate(SAMPLES)], "ord long, name string, category string, brands string")
        joined = self.part.join(F.broadcast(samples).alias("samples"), F.expr(f"samples.ord = p_partkey % {len(SAMPLES)}"))
        return joined.selectExpr(*split_columns(FOOD_COLUMNS))

    @cached_property
    def items(self) -> DataFrame:
        return self.lineitem.join(self.orders, F.expr("l_orderkey = o_orderkey")).selectExpr(*split_columns(ITEM_COLUMNS))

    @cached_property
    def profiles(self) -> DataFrame:
        return self.customer.selectExpr(*split_columns(PROFILE_COLUMNS))


def split_columns(text: str) -> list[str]:
    """The select items of a list without nested commas but in parentheses."""
    out, depth, item = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(item.strip())
            item = ""
        else:
            item += ch
    return [*out, item.strip()]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_: str = "", name: str | None = None):
    """Registers a function of Tables as a query, with its SQL over the same tables (``with_``: more common tables of it)."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = f"with {CTES}{', ' + with_ if with_ else ''} {sql}"
        return f

    return add
