"""Bronze to silver to gold to platinum: the product and reference pipelines as chains of the library's operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text
from ..functions.numbers import round_even
from ..operators import aggregates, cluster, columns, filters, matching, ranking
from ..operators.columns import q
from ..operators.settle import settled
from ..sources import files

# Sums that stand in for missing aggregates.
SUMS = {
    "Omega-3 (g)": ["Alpha-Linolenic Acid (g)", "EPA (g)", "DHA (g)"],
    "Omega-6 (g)": ["Linoleic Acid (g)", "Arachidonic Acid (g)"],
}
# A product's macros.
MACROS = ["Energy (KCAL)", "Protein (g)", "Carbohydrate (g)", "Fat (g)"]
# How much of a unit is in a gram.
UNITS_IN_GRAM = {"(mg)": 1e3, "(ug)": 1e6, "(mcg)": 1e6}


@dataclass
class Source:
    """How a source's table becomes silver: names, preferences, taxonomy and the columns of the uniform schema."""

    name: str
    aliases: Mapping[str, str]
    descriptor: Column
    text: Sequence[str]
    nutrients: Sequence[str]
    priorities: Mapping[str, Sequence[str]] = field(default_factory=dict)
    serving: tuple[str, str] | None = None


def silver(df: DataFrame, source: Source) -> tuple[DataFrame, DataFrame]:
    """(clean, flagged) rows of a source in the uniform schema, with ``semantic_descriptor`` and ``data_source``."""
    made = df.withColumn("semantic_descriptor", source.descriptor)
    if source.serving:
        made = made.withColumn("serving_weight", text.serving_grams(*source.serving))
    made = columns.prefer(columns.unit_columns(made), source.priorities)
    made = columns.impute_sums(columns.cap_impossible(columns.harmonise(made, source.aliases)), SUMS)
    shown = [*source.text, *(["serving_weight"] if source.serving else []), "semantic_descriptor"]
    out = columns.uniform(made, shown, source.nutrients).withColumn("data_source", F.lit(source.name))
    return filters.physics(out, "Protein (g)", "Fat (g)", "Carbohydrate (g)")


def from_grams(df: DataFrame) -> DataFrame:
    """Amounts of a dump that gives everything in grams, in the units of their columns' names."""
    scale = lambda c: next((f for unit, f in UNITS_IN_GRAM.items() if unit in c), None)
    return df.withColumns({c: q(c) * scale(c) for c in df.columns if scale(c)})


def products_silver(df: DataFrame, id_col: str, name: str, category: str, nutrients: Sequence[str], country: tuple[str, str] | None = None, squashed: Sequence[str] = ()) -> DataFrame:
    """Archetypes of products: complete rows of a country, by normalised name and category (null categories are one), clustered within 10 % of all nutrients; means and spreads of each cluster."""
    rows = df.where(filters.holds(*country)) if country else df
    rows = columns.cap_impossible(from_grams(filters.complete(rows, [m for m in MACROS if m in df.columns])))
    rows = columns.completeness(rows.withColumns({"norm_name": text.plain_name(name), "main_category_en": q(category)}), nutrients)
    rows = rows.withColumn("size_variation", text.sizes_in(name))
    found = cluster.by_tolerance(rows, ["norm_name", "main_category_en"], id_col, nutrients, "nutri_count").withColumnRenamed("cluster", "arc_id")
    joined = rows.join(found, id_col).withColumns({n: round_even(n) for n in nutrients if n == "Total Weight (g)"})
    return aggregates.archetypes(joined, ["norm_name", "main_category_en", "arc_id"], nutrients, [*squashed, "size_variation"], {"nutri_count": id_col})


def products_gold(df: DataFrame, id_col: str, name: str, category: str, brands: str, nutrients: Sequence[str]) -> DataFrame:
    """Taxonomy nodes: labelled products, spellings merged at 93 within label and category, then meanings at 85 with compatible nutrients; composites and supplements stay as they are."""
    labelled = df.withColumn("food_type_label", classify.label(category, name))
    base = labelled.where(F.col("food_type_label").isin("single", "category"))
    spelt = cluster.by_spelling(base, [F.col("food_type_label"), text.spelling_block(category, name)], id_col, name, 93).withColumnRenamed("cluster", "_spelling")
    done = columns.completeness(base, nutrients).join(spelt.drop("score"), id_col)
    order = F.struct("nutri_count", -q(id_col))
    merged = done.groupBy("_spelling").agg(F.max_by(F.struct(*(q(c) for c in base.columns)), order).alias("r"), aggregates.squash(brands, r"\|", ("unknown", "nan")).alias("_brands"), F.count("*").alias("dedup_count"))
    merged = merged.select("r.*", "_brands", "dedup_count").withColumn("bare_name", text.without_brands(name, brands))
    energy, protein = (n if n in nutrients else nutrients[0] for n in ("Energy (KCAL)", "Protein (g)"))
    nodes = cluster.by_taxonomy(merged, [F.col("food_type_label"), text.taxonomy_block(category, energy, protein)], id_col, "bare_name", nutrients)
    joined = merged.join(nodes, id_col)
    variant = F.when(F.length("bare_name") > 2, F.struct(F.length("bare_name").alias("n"), F.col("bare_name").alias("v")))
    node = joined.groupBy("cluster", "food_type_label").agg(F.coalesce(F.min(variant)["v"], F.min("bare_name")).alias("food_variant_name"), aggregates.squash("_brands", r"\|").alias("brands"), *(F.avg(q(n)).alias(n) for n in nutrients), F.sum("dedup_count").alias("product_count"))
    node = node.withColumn("brand_count", F.when(F.col("brands") == "", 0).otherwise(F.size(F.split("brands", r" \| "))))
    rest = labelled.where(~F.col("food_type_label").isin("single", "category"))
    others = rest.select(q(id_col).alias("cluster"), "food_type_label", q(name).alias("food_variant_name"), q(brands).alias("brands"), *(q(n) for n in nutrients), F.lit(1).cast("long").alias("product_count"), F.lit(None).cast("int").alias("brand_count"))
    return node.unionByName(others)


def reference_gold(sources: Sequence[DataFrame], labels: DataFrame, id_col: str, name: str, macros: Sequence[str], micros: Sequence[str], least: float = 80) -> tuple[DataFrame, DataFrame]:
    """(archetypes, merge log) of reference foods: sources in order of preference by name, labels joined, names merged at 80 within label and descriptor, base rows and spreads."""
    rows = ranking.union_preferring(sources, F.lower(F.trim(q(name))), id_col)
    cache = labels.groupBy("source_id").agg(F.max_by("food_type_label", "ord").alias("food_type_label"))
    rows = rows.join(cache.withColumnRenamed("source_id", id_col), id_col, "left").withColumn("_short", text.without_cooking(name))
    rows = settled(columns.completeness(rows, [*macros, *micros]))  # read three times below
    found = cluster.by_spelling(rows, [F.col("food_type_label"), F.col("semantic_descriptor")], id_col, "_short", least, [("nutri_count", False)])
    joined = rows.join(found, id_col)
    gold = aggregates.base_rows(joined, "cluster", name, id_col, macros, micros)
    heads = rows.select(q(id_col).alias("cluster"), q(name).alias("base_target"))
    log = joined.where("score is not null").join(heads, "cluster").select(q(name).alias("merged_name"), "base_target", F.col("score").alias("fuzzy_score"), "semantic_descriptor", F.col("data_source").alias("merged_source"))
    return gold, log


def platinum(products: DataFrame, references: DataFrame, macros: Sequence[str], micros: Sequence[str], apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """(enriched, unmatched) products: micronutrients of the best reference by meaning and macros where the confidence is HIGH or MEDIUM. Both: (id, vector, macros); references also name, micros, is_raw, is_cooked."""
    best = matching.rerank(products, references, macros, apart=apart).where(F.col("confidence") != "LOW")
    info = references.select(F.col("id").alias("ref_id"), F.col("name").alias("ref_name"), *(q(m) for m in micros))
    enriched = products.join(best.withColumnRenamed("query_id", "id"), "id").join(info, "ref_id")
    return enriched, products.join(best.select(F.col("query_id").alias("id")), "id", "left_anti")


def app_foods(dump: DataFrame, nutrients: Mapping[str, str], required: Sequence[str], country: tuple[str, str] | None, code: str = "code", name: str = "product_name", brands: str = "brands", category: str = "categories_en", completeness: str = "completeness", in_mg: Sequence[str] = ("sodium_100g",), least_extra: int = 3) -> DataFrame:
    """Foods of the app from a product dump: (food_id, description, data_source, food_group, nutrients).

    Products of the country, complete enough, with all ``required`` amounts, none negative, ``least_extra`` others and a name. ``nutrients``: the app's name of each of the dump's columns; amounts
    of ``in_mg`` come in grams. The description is name and brands, the group the first of the listed categories.
    """
    rows = dump.where(filters.holds(*country)) if country and country[0] in dump.columns else dump
    there = [c for c in nutrients if c in dump.columns]
    rows = rows.withColumns({c: q(c).try_cast("double") for c in [*there, completeness]})
    rows = filters.good_quality(rows, required, [c for c in there if c not in required], name, completeness, least_extra=least_extra)
    blank = lambda c: F.coalesce(q(c), F.lit(""))
    described = F.regexp_replace(F.concat(blank(name), F.lit(" - "), blank(brands)), "^[ -]+|[ -]+$", "")
    amounts = [(q(c) * 1000 if c in in_mg else q(c)).alias(nutrients[c]) for c in there]
    group = F.get(F.split(q(category), ","), 0) if category in dump.columns else F.lit("Unknown")
    return rows.select(F.concat(F.lit("off_"), q(code).cast("string")).alias("food_id"), described.alias("description"), F.lit("OpenFoodFacts").alias("data_source"), group.alias("food_group"), *amounts)


def ingest_app_foods(spark: SparkSession, dump: str, out: str, nutrients: Mapping[str, str], required: Sequence[str], country: tuple[str, str] | None, limit: int | None = None, parts: int | None = None) -> DataFrame:
    """The run of ``app_foods``: scan of a tab-separated dump, to a Parquet table. ``limit``: most products, after the country filter, as a trial run may set it."""
    wanted = ["code", "product_name", "brands", "categories_en", "completeness", *([country[0]] if country else []), *nutrients]
    rows = files.read_tsv(spark, dump, wanted, parts, drop_bad=True)
    rows = rows.where(filters.holds(*country)).limit(limit) if country and limit else rows.limit(limit) if limit else rows
    files.write_parquet(app_foods(rows, nutrients, required, country), out)
    return files.read_parquet(spark, out)


def store_mapping(dump: DataFrame, foods: DataFrame, macros: Mapping[str, str], country: tuple[str, str] | None, code: str = "code", name: str = "product_name", brands: str = "brands", least: float = 70, most: float = 0.10) -> DataFrame:
    """(product_id, product_name, brands, food_id, food_name, name_score, deviation): products of the country and the food that each is sold as, through both gates.

    ``macros``: the foods' column of each of the dump's. Products without a name or with an unreadable macro have no match.
    """
    rows = dump.where(filters.holds(*country)) if country else dump
    products = rows.select(q(code).alias("id"), q(name).alias("name"), q(brands).alias("brands"), *(q(c).try_cast("double").alias(n) for c, n in macros.items()))
    products = products.where(F.trim("name") != "").dropna(subset=list(macros.values()))
    best = matching.by_name_and_macros(products, foods, list(macros.values()), least, most)
    named = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "brands")
    return best.join(named, "product_id").join(foods.select(F.col("id").alias("food_id"), F.col("name").alias("food_name")), "food_id").select("product_id", "product_name", "brands", "food_id", "food_name", "name_score", "deviation")


def match_store_products(spark: SparkSession, dump: str, foods: DataFrame, out: str, macros: Mapping[str, str], country: tuple[str, str] | None, least: float = 70, most: float = 0.10, parts: int | None = None) -> DataFrame:
    """The run of ``store_mapping``: scan of a tab-separated dump, bad lines skipped, to a Parquet table."""
    wanted = ["code", "product_name", "brands", *([country[0]] if country else []), *macros]
    files.write_parquet(store_mapping(files.read_tsv(spark, dump, wanted, parts, drop_bad=True), foods, macros, country, least=least, most=most), out)
    return files.read_parquet(spark, out)
