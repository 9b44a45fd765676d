"""Further queries: records, groups of products, sources' quality and two-pass merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, numbers, text
from ..operators import aggregates, cluster
from ..sources import files
from .base import query
from .names import holds


@query("select id, name, calories, protein, portion_size from (values ('1', 'Chicken Breast', 165.0, 31.0, 150.0), ('2', 'Brown Rice', 111.0, 2.6, 150.0), ('3', 'Broccoli', 34.0, 2.8, 100.0), ('4', 'Almonds', 579.0, 21.0, 30.0), ('5', 'Olive Oil', 884.0, 0.0, 15.0), ('6', 'Spinach', 23.0, 2.9, 100.0)) f(id, name, calories, protein, portion_size)".replace("select id, name, calories, protein, portion_size", "select id, name, calories::double as calories, protein::double as protein, portion_size::double as portion_size"))
def mock_foods(t):
    return files.mock_foods(t.spark).select("id", "name", "calories", F.col("nutrients")["protein"].alias("protein"), "portion_size")


@query("select cast(food_id as varchar) as id, name, kcal as calories, coalesce(protein, 0) as protein, coalesce(fiber, 0) as fiber, 0.0::double as absent from foods where trim(name) <> ''")
def food_records(t):
    got = files.read_foods(t.foods, ["food_id"], "name", {"calories": "kcal", "protein": "protein", "fiber": "fiber", "absent": "none"})
    return got.select("id", "name", "calories", *(F.col("nutrients")[n].alias(n) for n in ("protein", "fiber", "absent")))


@query("select food_id, coalesce(protein, 0) as exact, coalesce(fat, 0) as folded, coalesce(sodium, 0) as part, 0.0::double as none from foods")
def nutrient_lookup(t):
    held = F.create_map(*(x for n in ("protein", "fat", "sodium") for x in (F.lit({"protein": "protein", "fat": "FAT (g)", "sodium": "Sodium (mg)"}[n]), F.coalesce(n, F.lit(0.0)))))
    rows = t.foods.select("food_id", held.alias("m"))
    return rows.select("food_id", *(aggregates.amount_of("m", F.lit(n)).alias(a) for n, a in (("protein", "exact"), ("fat (G)", "folded"), ("sodium", "part"), ("iron", "none"))))


@query(f"select food_id, {' or '.join(holds('n', w) for w, on in classify.TOGGLES.values() if on)} as out_by_default, {holds('n', ['dried', 'freeze-dried'])} or {holds('n', ['yeast extract', 'marmite', 'vegemite'])} or {holds('n', ['instant breakfast', 'drink mix, powder', 'meal replacement'])} as out_by_choice from (select food_id, lower(name) as n from foods)")
def toggled_groups(t):
    return t.foods.select("food_id", classify.toggled("name").alias("out_by_default"), classify.toggled("name", {"liver": False, "dried_herbs": True}).alias("out_by_choice"))


@query("select a.food_id, abs(a.kcal - b.kcal) <= greatest(10, 0.15 * a.kcal) and abs(coalesce(a.fat, 0) - coalesce(b.fat, 0)) <= greatest(1, 0.15 * coalesce(a.fat, 0)) as near from foods a join foods b on b.food_id = a.food_id + 3")
def nutrition_near(t):
    other = t.foods.select((F.col("food_id") - 3).alias("food_id"), F.col("kcal").alias("k2"), F.col("fat").alias("f2"))
    return t.foods.join(other, "food_id").select("food_id", numbers.near_first(["kcal", "fat"], ["k2", "f2"], [10, 1]).alias("near"))


GROUPS = "groups as (select food_id, p_brand, food_id % 50 as cluster, p_name, kcal, food_id % 7 + 1 as members from foods)"


@query("select cluster as group_id, max_by(food_id, members * 1000000000 - food_id) as canonical_id, max_by(p_name, members * 1000000000 - food_id) as p_name, max_by(kcal, members * 1000000000 - food_id) as kcal, string_agg(distinct p_brand, ',' order by p_brand) as brands, count(*) as n, cast(sum(members) as bigint) as members from groups group by cluster", GROUPS)
def semantic_merge(t):
    rows = t.foods.select("food_id", F.array("p_brand").alias("brands"), (F.col("food_id") % 50).alias("cluster"), "p_name", "kcal", (F.col("food_id") % 7 + 1).alias("members"))
    out = aggregates.merge_groups(rows, "cluster", "food_id", "members", "brands", ["p_name", "kcal"])
    return out.select("group_id", "canonical_id", "p_name", "kcal", F.array_join("brands", ",").alias("brands"), F.size("food_ids").cast("long").alias("n"), "members")


@query("select food_id, cluster as group_id from groups", GROUPS)
def group_mapping(t):
    return aggregates.group_members(t.foods.groupBy((F.col("food_id") % 50).alias("group_id")).agg(F.collect_list("food_id").alias("food_ids")))


@query("select p_type, round(avg(protein), 10) as protein, case when min(protein) < max(protein) then min(protein) end as protein_min, case when min(protein) < max(protein) then max(protein) end as protein_max, count(distinct p_brand) as source_count, coalesce((max(protein) - min(protein)) / nullif(max(protein), 0) > 0.1, false) as discrepancy from foods group by p_type")
def source_quality(t):
    return aggregates.source_quality(t.foods, ["p_type"], "p_brand", ["protein"]).withColumn("protein", F.round("protein", 10))


@query()
def name_variations(t):
    return t.foods.where("name <> ''").groupBy("category").agg(aggregates.name_variations(F.collect_set(F.concat_ws(", ", "name", "p_type"))).alias("variations"))


@query(f"select case when label in ('single', 'category') then 'unified' when label = 'composite' then 'composite' else 'unlabelled' end as split, count(*) as n from (select case when {holds('c', ['milk'])} then 'single' when {holds('c', ['pizza', 'lasagne'])} then 'composite' end as label from (select lower(category) as c from foods)) group by 1")
def label_split(t):
    low = F.lower("category")
    label = F.when(classify.any_in(low, ["milk"]), "single").when(classify.any_in(low, ["pizza", "lasagne"]), "composite")
    split = F.when(label.isin("single", "category"), "unified").when(label == "composite", "composite").otherwise("unlabelled")
    return t.foods.groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query()
def two_pass_merge(t):
    """Names of the first two sources merged at 60 within a block, then those of the third at 80; names of the third that match none are left out."""
    rows = t.foods.where("name <> ''").select("food_id", "p_type", "p_name", (F.col("food_id") % 3).alias("src"))
    first = cluster.by_spelling(rows.where("src < 2"), [F.col("p_type")], "food_id", "p_name", 60)
    heads = first.select(F.col("cluster").alias("food_id")).distinct().join(rows, "food_id")
    both = cluster.by_spelling(heads.unionByName(rows.where("src = 2")), [F.col("p_type")], "food_id", "p_name", 80, [("src", True)])
    return first.select("food_id", "cluster").unionByName(both.where("score is not null").select("food_id", "cluster"))


@query()
def brand_grouping(t):
    """Products of a brand and category merged where names are alike at 90; names and sizes as JSON lists."""
    rows = t.foods.where("name <> ''").withColumns({"plain": text.plain_name("name"), "size": text.first_size("name")})
    found = cluster.by_spelling(rows, [F.col("p_brand"), F.col("category")], "food_id", "plain", 90)
    return rows.join(found, "food_id").groupBy("cluster").agg(F.to_json(F.array_sort(F.collect_set("name"))).alias("names"), F.to_json(F.array_sort(F.collect_set("size"))).alias("sizes"))


NAMES = ["protein", "fat", "Sugar (g)", "Iron (mg)", "Vitamin D (mcg)", "Fiber (g)", "calories", "Monounsaturated Fat (g)"]


@query("select food_id, nutrient, case when nutrient in ('protein', 'fat') then 'g' when contains(nutrient, '(mg)') then 'mg' when contains(nutrient, '(mcg)') then 'mcg' when contains(nutrient, '(g)') then 'g' else '' end as unit from (select food_id, [" + ", ".join(f"'{n}'" for n in NAMES) + "][food_id % 8 + 1] as nutrient from foods)")
def nutrient_units(t):
    named = t.foods.select("food_id", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("food_id") % 8 + 1).cast("int")).alias("nutrient"))
    return named.select("food_id", "nutrient", text.unit_of("nutrient").alias("unit"))
