import random
import re

from pyspark.sql import functions as F

from larder.functions import classify, fixed, text
from larder.queries import QUERIES


def test_first_rule_is_that_of_the_rules_one_by_one(spark):
    rng = random.Random(3)
    words = [w for ws, _ in fixed.KEYWORD_DESCRIPTORS for w in ws]
    names = ["".join(rng.choice([rng.choice(words), rng.choice(words)[:3], " ", ", ", "raw", "Cooked"]) for _ in range(rng.randint(0, 5))) for _ in range(3000)] + [None, "", "raw", "a\nraw", "Pears, \\E fried"]
    rules = [(["pea", "a.c"], "x"), (["pear", "c", "q\\d"], "y"), (["pe"], "z")]

    def one(name, table, otherwise):
        return next((d for ws, d in table if name is not None and any(w in name for w in ws)), otherwise)

    def core(name):
        m = name and re.match(rf"(?i)^(.*?),?\s*[^,]*?(?:{text.COOKING}).*$", name)
        return (m and m[1].strip(" ")) or name

    df = spark.createDataFrame([(n,) for n in names + ["pear", "pe", "a.c", "abc", "xq\\dy", "xq7y"]], "name string")
    got = df.select("name", text.without_cooking("name").alias("core"), classify.keyword_descriptor("name").alias("d"), classify.first_rule(F.col("name"), rules).alias("r")).collect()
    for r in got:
        low = lambda s: s and s.lower()
        assert r.core == core(r["name"])
        assert r.d == one(low(core(r["name"])), fixed.KEYWORD_DESCRIPTORS, one(low(r["name"]), fixed.KEYWORD_DESCRIPTORS, classify.UNKNOWN))
        assert r.r == one(r["name"], rules, None)


def test_a_name_is_cut_once_and_not_once_a_rule(spark):
    for name in ("semantic_descriptor", "source_silver"):
        text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < text.count("regexp_extract(") <= 2


def test_reference_rows_are_made_once(spark):
    plan = QUERIES["reference_gold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan
