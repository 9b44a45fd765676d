"""Plans that must keep their shape: pruned scans, limits before shuffles, no Python where built-ins do."""

import pytest

from larder.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "scan_prune")
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_returnflag), GreaterThanOrEqual(l_shipdate" in text
    assert "l_extendedprice" not in text.split("ReadSchema:")[1]


def test_dedup_is_cut_before_the_shuffle(spark):
    assert plan(spark, "prep_priority_dedup").count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["classify_name", "portion_rules", "plan_fitness", "squash_stats", "keyword_overlap_match", "trio_variety", "semantic_descriptor", "limits_by_strategy"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text and "Cartesian" not in text
