from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import similarity, text
from larder.functions.numbers import round_significant
from larder.plans import targets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("said", "grams"), [("500g", 500), ("1kg", 1000), ("12 x 330ml", 3960), ("4x250g", 1000), ("1.5 kg", 1500), (None, None), (" ", None), ("1 lb", 1000), ("6 large eggs", 6000), ("1,5 kg", 5000), ("33cl", None)])
def test_weights(spark, said, grams):
    assert one(spark, text.weight_grams(F.lit(said).cast("string"))) == grams


@pytest.mark.parametrize(("said", "size", "grams"), [("Heinz Baked Beans 400g", "400g", 400), ("Tesco Semi Skimmed Milk 2 Pints", "2 pint", None), ("Coca Cola 1.5L", "1.5l", 1500), ("Walkers Crisps 6 x 25g", "6 x 25g", 25), ("Organic Eggs Free Range", None, None), ("Cathedral City Cheddar 350g", "350g", 350)])
def test_sizes(spark, said, size, grams):
    assert one(spark, text.first_size(F.lit(said))) == size
    assert one(spark, text.size_grams(text.first_size(F.lit(said)))) == grams


@pytest.mark.parametrize(("said", "base"), [("Apples, raw, with skin", "Apples"), ("Beef, ground, 80% lean, raw", "Beef, ground, 80% lean"), ("Strawberries, raw", "Strawberries, raw")])
def test_cooking(spark, said, base):
    assert one(spark, text.without_cooking(F.lit(said))) == base


def test_blocks(spark):
    assert one(spark, text.spelling_block(F.lit(None).cast("string"), F.lit("tescos chedder"))) == "__NOCAT_tescos"
    assert one(spark, text.spelling_block(F.lit(" "), F.lit(""))) == "__EMPTY__"
    assert one(spark, text.taxonomy_block(F.lit(None).cast("string"), F.lit(250.0), F.lit(15.0))) == "__NOCAT_K200_P20"


@pytest.mark.parametrize(("v", "want"), [(0.0, 0.0), (1234.5, 1230.0), (0.0012349, 0.00123), (-98765.0, -98800.0), (None, None), (100.0, 100.0)])
def test_significant(spark, v, want):
    got = one(spark, round_significant(F.lit(v).cast("double")))
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(("age", "sex", "kg", "cm", "level", "want"), [(25, "male", 70, 175, "moderately_active", 2594.3), (30, "female", 60, 165, "sedentary", 1584.3), (5, "male", 20, 110, "very_active", 1496.4)])
def test_energy(spark, age, sex, kg, cm, level, want):
    rate = targets.basal_rate(F.lit(kg), F.lit(cm), F.lit(age), F.lit(sex)) * targets.activity_factor(F.lit(level))
    assert one(spark, rate) == pytest.approx(want, abs=0.1)


def slow_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return 100.0 if not a and not b else 200.0 * row[-1] / (len(a) + len(b))


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_is_by_common_subsequence(a, b):
    assert similarity.ratio(a, b) == pytest.approx(slow_ratio(a, b))


def test_token_ratios():
    assert similarity.token_sort_ratio("cheddar tesco", "tesco cheddar") == 100
    assert similarity.token_set_ratio("peanut butter", "butter") == 100
    assert similarity.token_set_ratio("a b", "c d") == pytest.approx(similarity.ratio("a b", "c d"))
    assert similarity.token_set_ratio("", "x") == 0
    assert similarity.sequence_ratio("Abc", "abd") == SequenceMatcher(None, "abc", "abd").ratio()


def test_age_bounds():
    assert targets.age_bounds("0-6 months") == (0, 0.5)
    assert targets.age_bounds("51+ years") == (51, None)
    assert targets.age_bounds("19-50") == (19, 50)
    assert targets.age_bounds("athlete_strength") is None


@pytest.mark.parametrize(("names", "want"), [(["Beef, ground, raw", "Beef, ground, lean", "Beef, ground,"], "Beef, ground [base, lean, raw]"), (["Milk"], "Milk"), ([], ""), (["ab c", "xy"], "ab c | xy"), (["Oat milk", "Oat bran", None], "Oat [bran, milk]")])
def test_name_variations(spark, names, want):
    from larder.operators.aggregates import name_variations

    assert one(spark, name_variations(F.lit(names) if names else F.array().cast("array<string>"))) == want
