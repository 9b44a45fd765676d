import re

from pyspark.sql import functions as F

from larder.functions import fixed
from larder.operators import filters


def test_counts_come_with_the_filter(spark, capfd):
    names = ["Baby food", "Milk", None, "", "Infant formula", "Beef, raw", "Bacon"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id long, name string")
    kept, seen = filters.wanted(df, "name", also=["bacon"])
    rows = kept.collect()
    out = [n for n in names if n is not None and (any(re.search(p, n.lower()) for p in fixed.EXCLUDED_NAMES) or "bacon" in n.lower())]
    assert seen.get == {"kept": len(names) - len(out), "excluded": len(out)} and len(rows) == len(names) - len(out) and out
    assert rows[0].asDict().keys() == {"id", "name"}
    kept, _ = filters.wanted(df, "name")
    kept.explain()
    assert capfd.readouterr().out.count("Scan") == 1


def test_physics_writes_both_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, 50.0, 50.0, 50.0), (2, 10.0, None, 5.0), (3, None, None, None)], "id long, protein double, fat double, carbs double")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    watched = df.mapInArrow(count, df.schema)
    assert filters.write_physics(watched, str(tmp_path / "split"), "protein", "fat", "carbs") == {"clean": 2, "flagged": 1}
    assert reads.value == 3
    got = spark.read.parquet(str(tmp_path / "split"))
    assert sorted((r.id, r.flagged, r.flag_reason) for r in got.collect()) == [(1, "true", "MACRO_SUM(P+F+C)=150.0g>105g; "), (2, "false", ""), (3, "false", "")]
    clean, flagged = filters.physics(df, "protein", "fat", "carbs")
    assert clean.count() == 2 and flagged.first().id == 1


def test_any_number_of_conditions(spark):
    out, seen = filters.counted(spark.range(10), even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))
    assert out.count() == 10 and seen.get == {"even": 5, "none": 0}
