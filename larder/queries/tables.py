"""Queries of projections, filters, joins, aggregations and rankings over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import aggregates, columns, filters, matching, ranking
from ..operators.settle import folder, settled
from ..sources import keyed
from .base import query

NUTRIENTS = ["kcal", "protein", "fat", "carbs", "fiber", "sodium"]
KEYED = "(select *, upper(trim(p_type)) as kind, p_brand as maker from foods)"


def cols(text: str, names=NUTRIENTS, sep: str = ", ") -> str:
    """The text for each name, $ standing for it."""
    return sep.join(text.replace("$", n) for n in names)


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1999-01-01' and l_returnflag = 'R'")
def scan_prune(t):
    wanted = ["l_orderkey", "l_linenumber", "l_quantity", "not_there"]
    return columns.keep(t.lineitem.where("l_shipdate >= timestamp '1999-01-01' and l_returnflag = 'R'"), wanted)


@query("select food_id, name, kcal, protein, fat, carbs, fiber, sodium from foods")
def drop_by_prefix(t):
    return columns.drop_like(t.foods, ["category", "brands"], ["p_"])


@query("select p_partkey as food_id, p_name as title, coalesce(p_size, p_retailprice) as amount from part")
def alias_harmonise(t):
    cast = t.part.select("p_partkey", "p_name", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return columns.harmonise(cast, {"p_partkey": "food_id", "p_name": "title", "p_size": "amount", "p_retailprice": "amount"})


@query("select food_id, coalesce(fiber, carbs, fat) as best, coalesce(protein, kcal) as other from foods")
def priority_coalesce(t):
    return columns.prefer(t.foods, {"best": ["absent", "fiber", "carbs", "fat"], "other": ["protein", "kcal"]}).select("food_id", "best", "other")


@query('select food_id, coalesce(protein, fat / 1000) as "Protein (g)", sodium as "Iron (mg)", coalesce(kcal / 4.184, null) as "Energy (KCAL)" from foods')
def unit_convert(t):
    raw = t.foods.select("food_id", F.col("protein").alias("Protein (g)"), F.col("fat").alias("protein_MG_100G"), F.col("sodium").alias("iron_MG_100G"), F.col("kcal").alias("energy_KJ_100G"))
    return columns.unit_columns(raw)


@query('select food_id, case when kcal <= 900 then kcal end as "Energy (KCAL)", case when carbs <= 100 then carbs end as "Carbohydrate (g)", sodium as "Sodium (mg)", sodium as "Total Weight (g)" from foods')
def cap_impossible(t):
    named = t.foods.select("food_id", F.col("kcal").alias("Energy (KCAL)"), F.col("carbs").alias("Carbohydrate (g)"), F.col("sodium").alias("Sodium (mg)"), F.col("sodium").alias("Total Weight (g)"))
    return columns.cap_impossible(named)


@query("select food_id, coalesce(protein, case when coalesce(fat, carbs, fiber) is not null then coalesce(fat, 0) + coalesce(carbs, 0) + coalesce(fiber, 0) end) as protein from foods")
def omega_impute(t):
    return columns.impute_sums(t.foods, {"protein": ["fat", "carbs", "fiber", "absent"]}).select("food_id", "protein")


@query("select cast(food_id as varchar) as food_id, name, cast(null as varchar) as origin, cast(null as double) as absent, case when fat = 0 then 0 else round_even(fat * pow(10, 2 - floor(log10(abs(fat)))), 0) / pow(10, 2 - floor(log10(abs(fat)))) end as fat, try_cast(p_brand as double) as p_brand from foods")
def uniform_schema(t):
    return columns.uniform(t.foods, ["food_id", "name", "origin"], ["fat", "absent", "p_brand"])


@query("select l_orderkey, l_linenumber, case when l_extendedprice = 0 then 0 else round_even(l_extendedprice * pow(10, 2 - floor(log10(abs(l_extendedprice)))), 0) / pow(10, 2 - floor(log10(abs(l_extendedprice)))) end as sig3, case when l_extendedprice = 0 then 0 else round_even(l_extendedprice * pow(10, 1 - floor(log10(abs(l_extendedprice)))), 0) / pow(10, 1 - floor(log10(abs(l_extendedprice)))) end as sig2, round_even(l_discount * 12.5 * 100, 0) / 100 as dp2 from lineitem")
def round_figures(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.round_significant("l_extendedprice").alias("sig3"), numbers.round_significant("l_extendedprice", 2).alias("sig2"), numbers.round_even(F.col("l_discount") * 12.5).alias("dp2"))


@query(f"select food_id, {cols('case when $ is null then 0 else 1 end', sep=' + ')} as nutri_count, 'off_' || food_id as uid, trim(concat_ws(' - ', name, brands), ' -') as title, string_split(category, ',')[1] as main, sodium * 1000 as sodium_mg from foods")
def completeness_count(t):
    done = columns.completeness(t.foods, NUTRIENTS)
    title = F.btrim(F.concat_ws(" - ", "name", "brands"), F.lit(" -"))
    return done.select("food_id", "nutri_count", F.concat(F.lit("off_"), "food_id").alias("uid"), title.alias("title"), F.split("category", ",")[0].alias("main"), (F.col("sodium") * 1000).alias("sodium_mg"))


@query("select event_id, user_id, k, row_number() over (partition by user_id order by event_id) as ordinal from (select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events) where k is not null")
def json_scalar_ordinal(t):
    from pyspark.sql import Window

    read = t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")
    return read.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))


@query("select user_id, max(case when event_type = 'click' then v end) as nut_click_kcal, max(case when event_type = 'error' then v end) as nut_error_kcal, max(case when event_type = 'view' then v end) as nut_view_kcal from (select user_id, event_type, arg_max(value, event_id) as v from events group by user_id, event_type) group by user_id")
def nested_flatten(t):
    one = F.struct(F.struct(F.col("event_type").alias("name"), F.lit("KCAL").alias("unitName")).alias("nutrient"), F.col("value").alias("amount"), F.lit(None).cast("string").alias("nutrientName"), F.lit(None).cast("string").alias("unitName"), F.lit(None).cast("double").alias("value"))
    nested = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", one.alias("n")))).alias("a")).select("user_id", F.transform("a", lambda x: x["n"]).alias("nutrients"))
    return columns.flatten_nutrients(nested, "user_id", "nutrients", ["nut_click_kcal", "nut_error_kcal", "nut_view_kcal"])


@query("select s_suppkey as id, s_name as name, s_acctbal as bal from supplier union all select c_custkey, c_name, null from customer")
def column_alignment(t):
    left = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    right = columns.align(left, t.customer.select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("Name"), "c_nationkey"))
    return left.unionByName(right, allowMissingColumns=True)


# Filters


@query("select food_id from foods where kcal is not null and protein is not null and fat is not null and carbs is not null")
def complete_macros(t):
    return filters.complete(t.foods, ["kcal", "protein", "fat", "carbs"]).select("food_id")


@query("select food_id from foods where coalesce(contains(lower(category), 'herbs'), false)")
def country_contains(t):
    return t.foods.where(filters.holds("category", "HERBS")).select("food_id")


@query("select food_id from foods where kcal / 1000 > 0.5 and protein >= 0 and fat >= 0 and (case when carbs is null then 0 else 1 end + case when fiber is null then 0 else 1 end + case when sodium is null then 0 else 1 end) >= 3 and trim(name) <> ''")
def quality_filter(t):
    return filters.good_quality(t.foods.withColumn("done", F.col("kcal") / 1000), ["protein", "fat"], ["carbs", "fiber", "sodium"], "name", "done").select("food_id")


@query("select food_id, case when s > 105 then 'MACRO_SUM(P+F+C)=' || format('{:.1f}', s) || 'g>105g; ' end as flag_reason from (select food_id, case when coalesce(protein, fat, carbs) is not null then round(coalesce(protein, 0) + coalesce(fat, 0) + coalesce(carbs, 0), 10) end as s from foods)")
def physics_split(t):
    tenths = t.foods.select("food_id", *(F.col(c) for c in ("protein", "fat", "carbs")))
    clean, flagged = filters.physics(tenths, "protein", "fat", "carbs")
    return clean.select("food_id", F.lit(None).cast("string").alias("flag_reason")).unionByName(flagged.select("food_id", "flag_reason"))


@query("select count(*) filter (where s is null or s <= 105) as clean, count(*) filter (where s > 105) as flagged from (select case when coalesce(protein, fat, carbs) is not null then round(coalesce(protein, 0) + coalesce(fat, 0) + coalesce(carbs, 0), 10) end as s from foods)")
def physics_counts(t):
    """How many foods the check of macros leaves and flags, from the pass that writes both."""
    marked, seen = filters.counted(filters.mark_physics(t.foods.select("food_id", "protein", "fat", "carbs"), "protein", "fat", "carbs"), clean=F.col("flag_reason") == "", flagged=F.col("flag_reason") != "")
    settled(marked)
    return t.spark.createDataFrame([(seen.get["clean"], seen.get["flagged"])], "clean long, flagged long")


@query("select food_id, name from foods where coalesce(protein, fat, fiber) is not null and not coalesce(list_contains(['herbs', 'spices'], lower(category)), false) and kcal >= 10")
def category_blacklist(t):
    return filters.without_categories(filters.any_value(t.foods, ["protein", "fat", "fiber"]), "category", ["Herbs", "SPICES"]).where("kcal >= 10").select("food_id", "name")


@query("select food_id, protein, case when carbs <= 100 then carbs end as carbs, case when kcal <= 900 then kcal end as kcal, coalesce(protein is not null and carbs <= 100 and kcal <= 900, false) as has_macros from foods")
def plausibility(t):
    return filters.plausible(t.foods.select("food_id", "protein", "carbs", "kcal"), ["protein", "carbs"], "kcal")


# Joins: the parts stand for products and for foods; none is its own match.


@query("select l_orderkey, l_linenumber, p_name, n_name from lineitem join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey left join nation on n_nationkey = s_nationkey")
def dimension_joins(t):
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    names = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")
    return facts.join(t.part.select("p_partkey", "p_name"), F.expr("l_partkey = p_partkey")).join(names, F.expr("l_suppkey = s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_name", "n_name")


@query("select id, max(a) as a, max(b) as b, max(c) as c from (select c_nationkey as id, count(*) as a, null as b, null as c from customer group by 1 union all select s_nationkey, null, count(*), null from supplier group by 1 union all select n_nationkey, null, null, n_regionkey from nation) group by id")
def nway_outer_merge(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("a"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("b"))
    return matching.outer_merge([a, b, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("c"))], ["id"])


@query("select d.doc_id, d.lang, l.quality from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) l on l.doc_id = d.doc_id")
def label_cache(t):
    cache = ranking.first_by(t.labels, ["doc_id"], [F.desc("quality")])
    return t.documents.select("doc_id", "lang").join(cache.select("doc_id", "quality"), "doc_id", "left")


WORDS = "list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 2)"


@query(f"""select product_id, food_id, n_keywords from (select *, row_number() over (partition by product_id order by n_keywords desc, food_id) as r from
    (select a.id as product_id, b.id as food_id, cast(count(*) as bigint) as n_keywords from (select p_partkey as id, unnest({WORDS}) as w from part) a
     join (select p_partkey as id, unnest(list_distinct({WORDS})) as w from part) b on a.w = b.w and a.id <> b.id group by 1, 2) where n_keywords >= 2) where r = 1""")
def keyword_overlap_match(t):
    words = F.filter(F.split(F.lower("p_name"), " "), lambda w: F.length(w) > 2)
    keyed = t.part.select(F.col("p_partkey").alias("id"), words.alias("keywords"))
    return matching.by_keywords(keyed, keyed, apart=True)


GATE = "greatest(case when f.kcal = 0 then case when p.kcal > 5 then cast('inf' as double) end else abs(p.kcal - f.kcal) / f.kcal end, case when f.sodium = 0 then case when p.sodium > 5 then cast('inf' as double) end else abs(p.sodium - f.sodium) / f.sodium end)"


@query(f"select p.food_id as product_id, f.food_id, round(coalesce({GATE}, 0), 9) as deviation from foods p join foods f on p.food_id <> f.food_id where coalesce({GATE}, 0) <= 0.1")
def macro_gate_match(t):
    named = t.foods.select(F.col("food_id").alias("id"), "kcal", "sodium")
    return matching.by_macros(named, named, ["kcal", "sodium"], apart=True, digits=9)


@query("select p.food_id as id, min_by(a.food_id, a.ord) as food_id from foods p join (values (0, 'milk', 1), (1, 'semi skimmed milk', 2), (2, 'raw', 3), (3, 'beef', 4)) a(ord, alias, food_id) on contains(lower(p.name), a.alias) group by p.food_id")
def alias_match(t):
    aliases = t.spark.createDataFrame([(0, "milk", 1), (1, "semi skimmed milk", 2), (2, "raw", 3), (3, "beef", 4)], "ord int, alias string, food_id int")
    return matching.by_alias(t.foods.select(F.col("food_id").alias("id"), "name"), aliases).withColumnRenamed("product_id", "id")


@query()
def alias_or_fuzzy_match(t):
    aliases = t.spark.createDataFrame([(0, "skimmed milk", 30), (1, "cheddar", 5)], "ord int, alias string, food_id int")
    named = t.foods.where("name <> ''").select(F.col("food_id").alias("id"), "name", "p_name")
    return matching.by_alias_or_name(named.select("id", F.concat_ws(" ", "name", "p_name").alias("name")), named.select("id", "name"), aliases)


@query()
def dual_gate_match(t):
    named = t.foods.where("name <> ''").select(F.col("food_id").alias("id"), "name", "kcal", "sodium")
    return matching.by_name_and_macros(named, named, ["kcal", "sodium"], 40, apart=True)


@query("""select query_id, ref_id, round(similarity, 9) as similarity, round(deviation, 9) as deviation, round(score, 9) as score,
    case when similarity >= 0.85 and (deviation is null or deviation <= 0.3) then 'HIGH' when similarity >= 0.85 and deviation <= 0.5 then 'MEDIUM' when similarity >= 0.7 and deviation <= 0.2 then 'HIGH' when similarity >= 0.7 and (deviation is null or deviation <= 0.35) then 'MEDIUM' when similarity >= 0.55 and deviation <= 0.15 then 'MEDIUM' else 'LOW' end as confidence
    from (select *, row_number() over (partition by query_id order by score desc, ref_id) as r from
    (select *, similarity + coalesce(0.3 * greatest(0, 0.3 - deviation), 0) + case when label % 3 = 0 then 0.05 when label % 3 = 1 then -0.05 else 0 end as score from
    (select q.vec_id as query_id, f.vec_id as ref_id, f.label, list_cosine_similarity(q.v, f.v) as similarity, case when greatest(q.label, f.label) < 1 then abs(q.label - f.label) else abs(q.label - f.label) / cast(greatest(q.label, f.label) as double) end as deviation,
        row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v, f.v) desc, f.vec_id) as near
     from (select *, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings) q join (select *, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings) f on q.vec_id <> f.vec_id) where near <= 5)) where r = 1""")
def cosine_topk_rerank(t):
    base = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("double").alias("m"), (F.col("label") % 3 == 0).alias("is_raw"), (F.col("label") % 3 == 1).alias("is_cooked"))
    best = matching.rerank(base, base, ["m"], apart=True)
    return best.select("query_id", "ref_id", *(F.round(c, 9).alias(c) for c in ("similarity", "deviation", "score")), "confidence")


@query("""select food_id, value from (select f.food_id, v.value, row_number() over (partition by f.food_id order by lower(f.name) = v.p desc, length(v.p) desc, v.ord) as r from foods f
    left join (values (0, 'milk', 10), (1, 'semi skimmed milk', 20), (2, 'almonds', 30), (3, 'raw', 40), (4, 'apples', 50)) v(ord, p, value) on contains(lower(f.name), v.p)) where r = 1""")
def longest_pattern_lookup(t):
    patterns = t.spark.createDataFrame([(0, "Milk", 10), (1, "semi skimmed milk", 20), (2, "almonds", 30), (3, "raw", 40), (4, "Apples", 50)], "ord int, pattern string, value int")
    return matching.by_longest_pattern(t.foods.select("food_id", "name"), "food_id", "name", patterns).select("food_id", "value")


@query("select food_id, rank, product_id from (select p_partkey % 97 as food_id, p_partkey as product_id, cast(row_number() over (partition by p_partkey % 97 order by p_partkey) as integer) as rank from part) where rank <= 5 and food_id in (select food_id from foods where name is not null)")
def store_lookup_top5(t):
    products = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).alias("food_id"))
    return matching.store_products(t.foods.where("name is not null").select(F.col("food_id").alias("id")), products)


@query("select distinct food_id from items")
def covered_keys(t):
    return t.foods.select("food_id").join(t.lineitem.select(F.col("l_partkey").alias("food_id")), "food_id", "left_semi")


# Aggregations


@query("select l_suppkey, round(avg(l_quantity) filter (where l_returnflag = 'A'), 10) as \"A\", round(avg(l_quantity) filter (where l_returnflag = 'N'), 10) as \"N\", round(avg(l_quantity) filter (where l_returnflag = 'R'), 10) as \"R\" from lineitem group by l_suppkey")
def pivot_mean(t):
    wide = aggregates.pivot_mean(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"])
    return wide.select("l_suppkey", *(F.round(c, 10).alias(c) for c in "ANR"))


@query("select user_id, arg_min(value, event_id) filter (where event_type = 'click') as click, arg_min(value, event_id) filter (where event_type = 'view') as view from events where event_type in ('click', 'view') group by user_id")
def pivot_first(t):
    return aggregates.pivot_first(t.events.where("event_type in ('click', 'view')"), "user_id", "event_type", "value", "event_id", ["click", "view"])


@query(f"""select kind, maker, {cols("round(avg($), 10) as $, case when min($) < max($) then min($) end as $_min, case when min($) < max($) then max($) end as $_max", ["kcal", "protein"])}, string_agg(distinct trim(p_name), ' | ' order by trim(p_name)) as p_name, arg_min(name, food_id) filter (where name is not null) as name, count(*) as n
    from {KEYED} group by kind, maker""")
def squash_stats(t):
    keyed = t.foods.withColumns({"kind": F.upper(F.trim("p_type")), "maker": F.col("p_brand"), "ord": F.when(F.col("name").isNotNull(), F.col("food_id"))})
    out = aggregates.archetypes(keyed, ["kind", "maker"], ["kcal", "protein"], ["p_name"], {"name": "ord"})
    return out.withColumns({c: F.round(c, 10) for c in ("kcal", "protein")})


@query("""select p_type, base_id, base_name, kcal, round(avg(fiber), 10) as fiber, case when min(fiber) < max(fiber) then min(fiber) end as fiber_min, case when min(fiber) < max(fiber) then max(fiber) end as fiber_max, coalesce((max(fiber) - min(fiber)) / max(fiber) > 0.1, false) as discrepancy, count(*) as n from
    (select s.p_type, s.cooked, s.fiber, b.food_id as base_id, b.name as base_name, b.kcal as kcal, b.cooked as base_cooked, bool_and(s.cooked) over (partition by s.p_type) as every from scored s join (select *, row_number() over (partition by p_type order by score desc, food_id) as r from scored) b on b.p_type = s.p_type and b.r = 1)
    where not cooked or base_cooked or every group by p_type, base_id, base_name, kcal""",
    """scored as (select p_type, food_id, name, fiber, kcal, regexp_matches(lower(name), 'fried|roasted|boiled|cooked|steamed|poached|microwaved|baked|canned|grilled|stewed|braised|toasted|simmered|barbecued') as cooked,
    case when contains(lower(name), 'raw') then 15 else 0 end + case when contains(lower(name), ' dry') or contains(lower(name), 'dried') then 10 else 0 end - case when regexp_matches(lower(name), 'fried|cooked|boiled|roasted|canned') then 20 else 0 end - 0.05 * length(name) as score from foods where name <> '')""")
def base_row_stats(t):
    out = aggregates.base_rows(t.foods.where("name <> ''"), "p_type", "name", "food_id", ["kcal"], ["fiber"])
    return out.withColumn("fiber", F.round("fiber", 10))


@query('select unnest([\'protein\', \'fat\', \'fiber\']) as "column", unnest([avg(case when protein is null then 0.0 else 1.0 end), avg(case when fat is null then 0.0 else 1.0 end), avg(case when fiber is null then 0.0 else 1.0 end)]) as share from foods')
def column_coverage(t):
    return aggregates.coverage(t.foods, ["protein", "fat", "fiber"])


@query("select count(*) as products, count(distinct category) as canonicals, count(name) / cast(count(distinct category) as double) as per_canonical, round(avg(kcal), 10) as mean_kcal, count(*) filter (where kcal > 500) as above, count(*) filter (where kcal > 500 and protein is not null) as both from foods")
def store_stats(t):
    return t.foods.agg(F.count("*").alias("products"), F.count_distinct("category").alias("canonicals"), (F.count("name") / F.count_distinct("category")).alias("per_canonical"), F.round(F.avg("kcal"), 10).alias("mean_kcal"), F.count_if(F.col("kcal") > 500).alias("above"), F.count_if((F.col("kcal") > 500) & F.col("protein").isNotNull()).alias("both"))


@query("select p_type, string_agg(distinct b, ' | ' order by b) as brands, sum(n) as n, round(avg(kcal), 10) as kcal, arg_min(p_name, length(p_name) * 100000 + food_id) as short_name from (select p_type, food_id, p_name, kcal, 1 as n, unnest(string_split(coalesce(brands, ''), '|')) as b, len(string_split(coalesce(brands, ''), '|')) as m from foods) where trim(b) <> '' group by p_type")
def cluster_merge(t):
    branded = t.foods.select("p_type", "food_id", "p_name", "kcal", F.explode(F.split(F.coalesce("brands", F.lit("")), r"\|")).alias("b")).where(F.trim("b") != "")
    return branded.groupBy("p_type").agg(aggregates.squash("b").alias("brands"), F.count("*").cast("decimal(38,0)").alias("n"), F.round(F.avg("kcal"), 10).alias("kcal"), F.min_by("p_name", F.length("p_name") * 100000 + F.col("food_id")).alias("short_name"))


# Rankings


@query("select food_id, p_type, p_brand, kcal from (select *, row_number() over (partition by p_type, p_brand order by case when category = 'herbs' then 0 when category is null then 1 else 2 end, food_id) as r from foods) where r = 1")
def prep_priority_dedup(t):
    rank = F.when(F.col("category") == "herbs", 0).when(F.col("category").isNull(), 1).otherwise(2)
    return ranking.first_by(t.foods, ["p_type", "p_brand"], [rank, "food_id"]).select("food_id", "p_type", "p_brand", "kcal")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) where r = 1")
def keep_last(t):
    return ranking.first_by(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_orderkey")])


@query("select p_partkey as id, case when p_partkey % 3 = 0 then p_retailprice * 2 else p_retailprice end as price, case when p_partkey % 3 = 0 then p_brand end as brand from part union all select -1, 1.0, 'new'")
def upsert_keep_last(t):
    stored = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    new = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 2).alias("price"), F.col("p_brand").alias("brand"))
    extra = t.spark.createDataFrame([(-1, 1.0, "new")], "id long, price double, brand string")
    return ranking.upsert(stored, new.unionByName(extra), "id")


@query("""select coalesce(s.s_suppkey, p.p_partkey) as id, case when s.s_suppkey is not null then s.s_name else p.p_name end as name, case when s.s_suppkey is null then p.p_size end as size, s.s_nationkey as nation from part p full join supplier s on s.s_suppkey = p.p_partkey""")
def keyed_upsert(t):
    """The parts as a table of files, then a batch of suppliers under the same keys: only the files that hold some of these are rewritten."""
    path = f"{folder(t.spark)}/keyed-{uuid.uuid4().hex}"
    keyed.upsert(t.spark, path, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), "id", rows_per_file=1000)
    keyed.upsert(t.spark, path, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), "id", rows_per_file=1000)
    return keyed.read(t.spark, path)


@query("select key, id, origin from (select *, row_number() over (partition by key order by origin, id) as r from (select lower(trim(p_name)) as key, p_partkey as id, 0 as origin from part where p_partkey % 2 = 0 union all select lower(trim(p_name)), p_partkey, 1 from part where p_partkey % 2 = 1)) where r = 1")
def union_by_name_prefer(t):
    part = lambda k: t.part.where(f"p_partkey % 2 = {k}").select(F.lower(F.trim("p_name")).alias("key"), F.col("p_partkey").alias("id"), F.lit(k).alias("origin"))
    return ranking.union_preferring([part(0), part(1)], F.col("key"), "id")


def _best_sql() -> str:
    rda = {"protein": 50.0, "fat": 65.0, "fiber": 28.0}
    share = {n: f"coalesce({n}, 0) / {v} / (kcal / 100)" for n, v in rda.items()}
    tops = " union ".join(f"select food_id from (select food_id, row_number() over (order by {s} * 100 desc, food_id) as r, {s} * 100 as s from foods where kcal >= 1) where r <= 30 and s > 0" for s in share.values())
    return f"select food_id as id, picked from (select f.food_id, case when p.food_id is null then 0 else 1 end as picked, row_number() over (order by case when p.food_id is null then 0 else 1 end desc, 0 + {' + '.join(share.values())} desc, f.food_id) as r from foods f left join ({tops}) p on p.food_id = f.food_id where kcal >= 1) where r <= 150"


@query(_best_sql())
def topn_per_nutrient(t):
    return ranking.best_sources(t.foods, "food_id", "kcal", {"protein": 50.0, "fat": 65.0, "fiber": 28.0}, 30, 150)


SIZED = "(select p_name as g, p_size % 7 as s, p_partkey as id from part)"


@query(f'select g as "group", s as size, n, n_sizes, n_sizes > 3 as suspicious from (select *, row_number() over (partition by g order by n desc, s) as r, count(*) over (partition by g) as n_sizes from (select g, s, count(*) as n from {SIZED} group by g, s)) where r <= 3')
def usual_sizes(t):
    return ranking.usual_sizes(t.part.select(F.col("p_name").alias("g"), (F.col("p_size") % 7).alias("s")), "g", "s")


@query(f"select g, s, id from (select *, row_number() over (partition by g, s order by id) as r from {SIZED}) f where r = 1 and (g, s) in (select (g, s) from (select g, s, row_number() over (partition by g order by count(*) desc, s) as r from {SIZED} group by g, s) where r <= 3)")
def size_variant_dedup(t):
    kept, _ = ranking.one_per_size(t.part.select(F.col("p_name").alias("g"), (F.col("p_size") % 7).alias("s"), F.col("p_partkey").alias("id")), "g", "s", "id")
    return kept.select("g", "s", "id")


@query("select food_id, p_name from (select *, row_number() over (partition by lower(p_name), p_type, round(kcal / 100, 0) order by food_id) as r from foods) where r = 1")
def exact_dedup(t):
    return ranking.first_by(t.foods, [F.lower("p_name"), "p_type", F.round(F.col("kcal") / 100, 0)], ["food_id"]).select("food_id", "p_name")


@query("select food_id, kcal, p_name from foods order by kcal desc nulls last, p_name, food_id limit 25")
def largest(t):
    return t.foods.orderBy(F.desc_nulls_last("kcal"), "p_name", "food_id").limit(25).select("food_id", "kcal", "p_name")


@query()
def seeded_sample(t):
    return ranking.sample(t.part, "p_partkey", 50).select("p_partkey")


@query()
def softmax_sample(t):
    return ranking.gumbel_sample(t.foods.withColumn("s", F.col("kcal") / 100), "food_id", "s", 50).select("food_id", "s")


@query()
def weighted_draw(t):
    return ranking.weighted_sample(t.foods, "food_id", "kcal", 50).select("food_id", "kcal")


@query("select a.food_id, abs(a.kcal - b.kcal) <= greatest(15, 0.15 * greatest(a.kcal, b.kcal)) and coalesce(abs(a.protein - b.protein) <= greatest(1.5, 0.15 * greatest(a.protein, b.protein)), true) as fits, case when a.protein is null or b.protein is null then null when greatest(a.protein, b.protein) < 1 then abs(a.protein - b.protein) else abs(a.protein - b.protein) / greatest(a.protein, b.protein) end as gap from foods a join foods b on b.food_id = a.food_id + 1")
def nutrition_compatible(t):
    a, b = t.foods.select("food_id", "kcal", "protein"), t.foods.select((F.col("food_id") - 1).alias("food_id"), F.col("kcal").alias("k2"), F.col("protein").alias("p2"))
    pairs = a.join(b, "food_id")
    return pairs.select("food_id", numbers.within(["kcal", "protein"], ["k2", "p2"], [15, 1.5]).alias("fits"), numbers.deviation_between(["protein"], ["p2"]).alias("gap"))
