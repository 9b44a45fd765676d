"""Compares a registered query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    found = query(spark, sf_dir)
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    assert sorted(found.columns) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=str)
    got = sorted((tuple(norm(r[n]) for n in names) for r in found.collect()), key=str)
    for a, b in zip(got, rows, strict=False):
        assert a == b, (names, a, b)
    assert len(got) == len(rows)
    return len(got)
