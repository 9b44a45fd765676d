"""The bronze-to-gold chains over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..plans import medallion
from .base import query
from .names import descriptor_sql

NUTRIENTS = ["Energy (KCAL)", "Protein (g)", "Carbohydrate (g)", "Fat (g)", "Sodium (mg)"]
SIG = "case when {0} = 0 then 0 else round_even({0} * pow(10, 2 - floor(log10(abs({0})))), 0) / pow(10, 2 - floor(log10(abs({0})))) end"


def dump(t):
    """Foods in the shape of a product dump, all amounts in grams."""
    return t.foods.select("food_id", "name", "category", "brands", "p_name", F.col("kcal").alias("Energy (KCAL)"), F.col("protein").alias("Protein (g)"), F.col("carbs").alias("Carbohydrate (g)"), F.col("fat").alias("Fat (g)"), (F.col("sodium") / 1000).alias("Sodium (mg)"))


@query(f"""select cast(food_id as varchar) as food_id, name as description, {descriptor_sql('core', descriptor_sql('n', f"'{classify.UNKNOWN}'"))} as semantic_descriptor, 'parts' as data_source,
    {SIG.format('kcal')} as "Energy (KCAL)", {SIG.format('protein')} as "Protein (g)", {SIG.format('carbs')} as "Carbohydrate (g)", {SIG.format('fat')} as "Fat (g)", {SIG.format('sodium')} as "Sodium (mg)" from
    (select food_id, name, lower(name) as n, lower(case when b = '' then name else b end) as core, case when kcal <= 900 then kcal end as kcal, protein, case when carbs <= 100 then carbs end as carbs, fat, sodium from
     (select *, trim(regexp_extract(name, '(?i)^(.*?),?\\s*[^,]*?(?:{text.COOKING}).*$', 1)) as b from foods))
    where coalesce(({SIG.format('protein')}), 0) + coalesce(({SIG.format('carbs')}), 0) + coalesce(({SIG.format('fat')}), 0) <= 105 or coalesce(protein, carbs, fat) is null""")
def source_silver(t):
    raw = t.foods
    raw = raw.select("food_id", "name", F.col("kcal").alias("energy"), F.col("protein").alias("prot"), "carbs", "fat", F.col("sodium").alias("sodium_MG_100G"))
    aliases = {"name": "description", "energy": "Energy (KCAL)", "prot": "Protein (g)", "carbs": "Carbohydrate (g)", "fat": "Fat (g)"}
    source = medallion.Source("parts", aliases, classify.keyword_descriptor("name"), ["food_id", "description"], NUTRIENTS)
    clean, _ = medallion.silver(raw, source)
    return clean


@query()
def product_silver(t):
    return medallion.products_silver(dump(t), "food_id", "name", "category", NUTRIENTS, squashed=["brands"])


@query()
def product_gold(t):
    return medallion.products_gold(dump(t), "food_id", "p_name", "category", "brands", NUTRIENTS)


@query()
def reference_gold(t):
    rows = dump(t).withColumns({"name": F.concat_ws(", ", "name", "p_name"), "semantic_descriptor": classify.keyword_descriptor("name"), "data_source": F.lit("parts")})
    labels = t.labels.select(F.col("doc_id").alias("source_id"), F.when(F.col("quality") == 1, "single").otherwise("category").alias("food_type_label"), F.lit(0).alias("ord"))
    gold, _ = medallion.reference_gold([rows.where("food_id % 2 = 0"), rows.where("food_id % 2 = 1")], labels, "food_id", "name", ["Energy (KCAL)", "Protein (g)"], ["Sodium (mg)"])
    return gold


@query()
def enriched_products(t):
    base = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("food "), "vec_id").alias("name"), F.array(F.col("label") + 1.0, F.lit(3.0), F.col("vec_id") % 5 + 0.0).alias("vector"), F.col("label").cast("double").alias("kcal"), (F.col("label") * 2.0).alias("iron"), (F.col("label") % 3 == 0).alias("is_raw"), (F.col("label") % 3 == 1).alias("is_cooked"))
    enriched, _ = medallion.platinum(base.select("id", "vector", "kcal"), base, ["kcal"], ["iron"], apart=True)
    return enriched.drop("vector")
