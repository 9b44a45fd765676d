"""Queries of string functions and classifiers over food names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, fixed, text
from ..functions.portions import RULES, portion
from ..operators import aggregates, filters
from ..operators.settle import settled
from .base import query

SIZE_RE = r"\b(\d+(?:\.\d+)?\s*(?:g|kg|ml|l|oz|lb|pc|pack|kcal|kj))\b"


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def holds(column: str, words) -> str:
    return f"coalesce(len(list_filter({listed(words)}, lambda w: contains({column}, w))) > 0, false)"


MANY, ONE = r"(\d+)\s*[x*]\s*(\d+(?:\.\d+)?)\s*(g|kg|ml|l)", r"(\d+(?:\.\d+)?)\s*(g|kg|ml|l)"


@query(f"""select food_id, case when packs <> '' then cast(packs as double) * cast(each as double) * case when unit in ('kg', 'l') then 1000 else 1 end
        when amount <> '' then cast(amount as double) * case when unit1 in ('kg', 'l') then 1000 else 1 end end as grams
    from (select food_id, regexp_extract(n, '{MANY}', 1) as packs, regexp_extract(n, '{MANY}', 2) as each, regexp_extract(n, '{MANY}', 3) as unit,
        regexp_extract(n, '{ONE}', 1) as amount, regexp_extract(n, '{ONE}', 2) as unit1 from (select food_id, lower(name) as n from foods))""")
def parse_weight(t):
    return t.foods.select("food_id", text.weight_grams("name").alias("grams"))


@query(rf"""select food_id, array_to_string(regexp_extract_all(lower(name), '{SIZE_RE}', 1), ' | ') as sizes,
    case when coalesce(n, '') = '' then 'unknown' else n end as norm_name from (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{SIZE_RE}', ' ', 'g'), '[^a-zA-Z0-9% ]', ' ', 'g'), '\s+', ' ', 'g')) as n from foods)""")
def normalize_name_sizes(t):
    return t.foods.select("food_id", text.sizes_in("name").alias("sizes"), text.plain_name("name").alias("norm_name"))


@query(f"""select food_id, size, coalesce(nullif(regexp_extract(size, '(\\d+(?:\\.\\d+)?)\\s*kg', 1), '')::double * 1000, nullif(regexp_extract(size, '(\\d+(?:\\.\\d+)?)\\s*g', 1), '')::double,
    nullif(regexp_extract(size, '(\\d+(?:\\.\\d+)?)\\s*ml', 1), '')::double, nullif(regexp_extract(size, '(\\d+(?:\\.\\d+)?)\\s*l', 1), '')::double * 1000) as grams
    from (select food_id, coalesce({", ".join(f"nullif(regexp_extract(lower(name), '{p}'), '')" for p in text.SIZE_FORMS)}) as size from foods)""")
def extract_size_grams(t):
    sized = t.foods.select("food_id", text.first_size("name").alias("size"))
    return sized.select("food_id", "size", text.size_grams("size").alias("grams"))


@query(f"select food_id, case when b = '' then name else b end as base from (select *, trim(regexp_extract(name, '(?i)^(.*?),?\\s*[^,]*?(?:{text.COOKING}).*$', 1)) as b from foods)")
def strip_cooking(t):
    return t.foods.select("food_id", text.without_cooking("name").alias("base"))


@query(rf"""select food_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(name, '')), '\d+(?:\.\d+)?\s*(?:kg|g|ml|l|pint|pack)\b', '', 'g'), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
    lambda w: length(w) > 2 and not list_contains({listed(fixed.STOP_WORDS)}, w)), ',') as words from foods""")
def keyword_extract(t):
    return t.foods.select("food_id", F.array_join(text.keywords("name"), ",").alias("words"))


@query(r"""select food_id, brand, product, lower(trim(brand)) || '::' || trim(regexp_replace(regexp_replace(lower(product), '\d+(?:\.\d+)?\s*(?:kg|g|ml|l|pint)\b', '', 'g'), '\s+', ' ', 'g')) as group_key from
    (select food_id, coalesce(case when pos > 0 then nullif(trim(substr(name, 1, pos - 1)), '') end, brands, '') as brand, case when pos > 0 then trim(substr(name, pos + 3)) else name end as product
     from (select *, instr(name, ' - ') as pos from foods) where name is not null)""")
def brand_group_key(t):
    cut = t.foods.where("name is not null").select("food_id", text.brand_of("name", "brands").alias("brand"), text.product_of("name").alias("product"))
    return cut.withColumn("group_key", text.group_key("brand", "product"))


@query(r"""select food_id, coalesce(nullif(trim(category), ''), '__NOCAT_' || nullif(regexp_split_to_array(trim(coalesce(name, '')), '\s+')[1], ''), '__EMPTY__') as spelling,
    coalesce(nullif(trim(category), ''), '__NOCAT_K' || cast(cast(round_even(kcal / 100, 0) * 100 as integer) as varchar) || '_P' || cast(cast(round_even(coalesce(protein, 0) / 10, 0) * 10 as integer) as varchar)) as taxonomy,
    cast(cast(trunc(kcal / 20) as integer) * 20 as varchar) || '|' || cast(cast(trunc(coalesce(protein, 0) / 2) as integer) * 2 as varchar) || '|' || cast(cast(trunc(coalesce(fat, 0) / 2) as integer) * 2 as varchar) as bucket from foods""")
def block_keys(t):
    return t.foods.select("food_id", text.spelling_block("category", "name").alias("spelling"), text.taxonomy_block("category", "kcal", "protein").alias("taxonomy"), text.nutrition_bucket("kcal", "protein", "fat").alias("bucket"))


@query(f"select food_id, regexp_matches(lower(name), '{text.RAW_STATE}') as raw, regexp_matches(lower(name), '{text.COOKED_STATE}') as cooked, regexp_replace(lower(name), '{SIZE_RE}', '[SIZE]', 'g') as marked from foods")
def name_state(t):
    return t.foods.select("food_id", text.is_raw("name").alias("raw"), text.is_cooked("name").alias("cooked"), text.with_size_mark("name").alias("marked"))


@query("select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) as word from documents) group by word order by n desc, word limit 300")
def word_frequency(t):
    return aggregates.word_counts(t.documents, text.letters("text"))


def label_sql(column: str) -> str:
    exact = [("supplement", fixed.SUPPLEMENT_CATEGORIES), ("composite", fixed.COMPOSITE_CATEGORIES), ("single", fixed.SINGLE_CATEGORIES), ("category", fixed.CATEGORY_CATEGORIES)]
    part = [("supplement", fixed.SUPPLEMENT_KEYWORDS), ("composite", fixed.COMPOSITE_KEYWORDS), ("single", fixed.SINGLE_KEYWORDS), ("category", fixed.CATEGORY_KEYWORDS)]
    cases = [f"when coalesce({column}, '') = '' or contains({column}, ':') then null"]
    cases += [f"when list_contains({listed(w)}, {column}) then '{label}'" for label, w in exact] + [f"when {holds(column, w)} then '{label}'" for label, w in part]
    return "case " + " ".join(cases) + " end"


def name_label_sql(column: str) -> str:
    return f"""case when coalesce({column}, '') = '' then 'unknown' when {holds(column, fixed.SUPPLEMENT_KEYWORDS)} then 'supplement'
        when {holds(column, fixed.COMPOSITE_NAMES)} and not {holds(column, fixed.FALSE_COMPOSITE_NAMES)} then 'composite'
        when {holds(column, fixed.SINGLE_NAMES)} and not {holds(column, fixed.NOT_SINGLE_NAMES)} then 'single' else 'category' end"""


@query(f"select food_id, {label_sql('c')} as label from (select food_id, lower(trim(category)) as c from foods)")
def classify_category(t):
    return t.foods.select("food_id", classify.category_label("category").alias("label"))


@query(f"select food_id, {name_label_sql('c')} as label from (select food_id, lower(trim(name)) as c from foods)")
def classify_name(t):
    return t.foods.select("food_id", classify.name_label("name").alias("label"))


@query(f"""select label, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as percent from
    (select coalesce({label_sql('c')}, {name_label_sql('n')}) as label from (select lower(trim(category)) as c, lower(trim(name)) as n from foods)) group by label""")
def label_shares(t):
    labelled = t.foods.select(classify.label("category", "name").alias("label"))
    return aggregates.shares(labelled, "label").withColumnRenamed("value", "label")


def descriptor_sql(column: str, otherwise: str) -> str:
    return "case " + " ".join(f"when {holds(column, w)} then '{d}'" for w, d in fixed.KEYWORD_DESCRIPTORS) + f" else {otherwise} end"


@query(f"""select food_id, {descriptor_sql('core', descriptor_sql('whole', f"'{classify.UNKNOWN}'"))} as descriptor from (select food_id, lower(name) as whole, lower(case when b = '' then name else b end) as core from
    (select *, trim(regexp_extract(name, '(?i)^(.*?),?\\s*[^,]*?(?:{text.COOKING}).*$', 1)) as b from foods))""")
def semantic_descriptor(t):
    return t.foods.select("food_id", classify.keyword_descriptor("name").alias("descriptor"))


@query("select food_id, coalesce(" + ", ".join("case " + " ".join("when category = '{}' then '{}'".format(k.replace("'", "''"), v) for k, v in table.items()) + " end" for table in (fixed.USDA_DESCRIPTORS, fixed.FOODB_DESCRIPTORS)) + f", '{classify.UNKNOWN}') as descriptor from foods")
def mapped_descriptor(t):
    return t.foods.select("food_id", classify.mapped("category", fixed.FOODB_DESCRIPTORS | fixed.USDA_DESCRIPTORS).alias("descriptor"))


@query(f"""select food_id, case when {holds('n', fixed.PROCESSED_MEAT)} then 'processed' when {holds('n', fixed.RED_MEAT)} then 'red' end as meat,
    case when {holds('n', fixed.DRIED_SPICE)} then 'spice' when {holds('n', fixed.FRESH_HERB)} then 'herb' end as spice,
    {holds('n', [*fixed.DRIED_SPICE, *fixed.FRESH_HERB, *fixed.SAUCE])} as seasoning from (select food_id, lower(name) as n from foods)""")
def food_kinds(t):
    return t.foods.select("food_id", classify.meat_kind("name").alias("meat"), classify.spice_kind("name").alias("spice"), classify.is_seasoning("name").alias("seasoning"))


def _portion_test(words: str) -> str:
    single = [w for w in words.split(",") if w and "+" not in w]
    tests = ([holds("n", single)] if single else []) + ["(" + " and ".join(holds("n", [w]) for w in g.split("+")) + ")" for g in words.split(",") if "+" in g]
    return "(" + " or ".join(tests) + ")"


def _portion_sql(pick) -> str:
    cases = []
    for words, never, perishable, size, finer in RULES:
        inner = " ".join(f"when {_portion_test(f[0])} then {pick(f[1], f[2] if len(f) > 2 else perishable)}" for f in finer)
        value = f"case {inner} else {pick(size, perishable)} end" if inner else pick(size, perishable)
        cases.append(f"when {_portion_test(words)}" + (f" and not {holds('n', never.split(','))}" if never else "") + f" then {value}")
    return "case " + " ".join(cases) + f" else {pick(100, False)} end"


@query(f"select food_id, cast({_portion_sql(lambda s, p: str(s))} as integer) as pack_size, cast({_portion_sql(lambda s, p: str(p).lower())} as boolean) as perishable from (select food_id, lower(name) as n from foods)")
def portion_rules(t):
    return t.foods.select("food_id", portion("name").alias("p")).select("food_id", "p.*")


@query(f"""select food_id, sizes[1] as usual, len(sizes) as n from (select food_id, case {" ".join(f"when contains(n, '{k}') then {v}" for k, v in fixed.PACK_SIZES.items())} else [400] end as sizes from
    (select food_id, lower(coalesce(name, '') || ' ' || coalesce(category, '')) as n from foods))""")
def default_packs(t):
    sizes = t.foods.select("food_id", classify.pack_sizes("name", "category").alias("s"))
    return sizes.select("food_id", F.get("s", F.lit(0)).alias("usual"), F.size("s").cast("long").alias("n"))


EXCLUDED_SQL = "coalesce(regexp_matches(lower(name), '" + "|".join(f"(?:{p})" for p in fixed.EXCLUDED_NAMES) + "'), false)"


@query(f"select food_id, name from foods where not ({EXCLUDED_SQL} or coalesce(contains(lower(name), 'bacon'), false))")
def exclusion_filter(t):
    return t.foods.where(~classify.excluded("name", also=["Bacon"])).select("food_id", "name")


@query(f"select count(*) filter (where not out) as kept, count(*) filter (where out) as excluded from (select {EXCLUDED_SQL} or coalesce(contains(lower(name), 'bacon'), false) as out from foods)")
def exclusion_counts(t):
    """How many foods the exclusion leaves and drops, from the pass that filters."""
    kept, seen = filters.wanted(t.foods.select("food_id", "name"), "name", also=["Bacon"])
    settled(kept)
    return t.spark.createDataFrame([(seen.get["kept"], seen.get["excluded"])], "kept long, excluded long")


@query("""select pattern, count(*) as n, string_agg(name, ' | ' order by food_id) filter (where r <= 3) as examples from (select *, row_number() over (partition by pattern order by food_id) as r from
    (select food_id, name, coalesce(""" + ", ".join(f"case when regexp_matches(lower(name), '{p}') then '{p}' end" for p in fixed.EXCLUDED_NAMES) + ") as pattern from foods)) where pattern is not null group by pattern")
def pattern_attribution(t):
    return filters.attribute(t.foods, "food_id", "name", fixed.EXCLUDED_NAMES)


@query("select food_id, case when sim >= 0.85 and (dev is null or dev <= 0.3) then 'HIGH' when sim >= 0.85 and dev <= 0.5 then 'MEDIUM' when sim >= 0.7 and dev <= 0.2 then 'HIGH' when sim >= 0.7 and (dev is null or dev <= 0.35) then 'MEDIUM' when sim >= 0.55 and dev <= 0.15 then 'MEDIUM' else 'LOW' end as confidence from (select food_id, kcal / 1000 as sim, protein / 60 as dev from foods)")
def confidence_tiers(t):
    return t.foods.select("food_id", classify.confidence(F.col("kcal") / 1000, F.col("protein") / 60).alias("confidence"))


@query("""select food_id, case when coalesce(trim(brands), '') = '' then name when c = '' then name else c end as bare from (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    list_reduce(list_prepend(lower(name), list_filter(list_transform(string_split(lower(coalesce(brands, '')), '|'), lambda b: trim(b)), lambda b: length(b) > 2)), lambda a, b: regexp_replace(a, '\\b' || b || '\\b', '', 'g')),
    '\\bby\\b', '', 'g'), '\\btaste the difference\\b', '', 'g'), '\\bfinest\\b', '', 'g'), '\\bextra special\\b', '', 'g'), '\\bthe\\b', '', 'g'), '\\bfs\\b', '', 'g'), '[-,]', ' ', 'g'), '\\s+', ' ', 'g')) as c from foods)""")
def strip_brands(t):
    return t.foods.select("food_id", text.without_brands("name", "brands").alias("bare"))


@query("select food_id, case when lower(p_type) in ('small', 'medium') then kcal when lower(p_type) = 'large' then kcal * 28.35 end as grams from foods")
def serving_weight(t):
    unit = F.when(F.lower("p_type").isin("small", "medium"), "g").when(F.lower("p_type") == "large", " OZ ").otherwise("cup")
    return t.foods.select("food_id", text.serving_grams(F.col("kcal").cast("string"), unit).alias("grams"))
