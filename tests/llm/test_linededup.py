import re

from larder.llm import linededup
from larder.llm.queries import ORACLES, QUERIES

from .oracle import same


def brute(rows, run=2):
    seen, out, done = set(), [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None or (i, t) in done:
            out.append((i, done.get((i, t))))
            continue
        lines, gone = t.split("\n"), set()
        for a in range(len(lines) - run + 1):
            w = tuple(lines[a : a + run])
            if w in seen:
                gone.update(range(a, a + run))
            seen.add(w)
        done[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, done[i, t]))
    return sorted(out, key=str)


def test_sql(spark):
    assert same(spark, QUERIES["op10_line_dedup"], ORACLES["op10_line_dedup"], "/root/testdata/sf0.01") == 1000


def test_odd_rows(spark):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\ny"), (3, None), (4, ""), (5, "a"), (6, "a\nb"), (6, "a\nb"), (None, "q\nr"), (8, "q\nr\ns"), (9, "z\n" * 30000), (10, "\n\n\n"), (11, "b\nc\n\n")]
    df = spark.createDataFrame([(*r, 1, "w", 0) for r in rows], "doc_id long, text string, at int, mark string, id int")
    for run in (2, 3):
        out = linededup.dedup_lines(df, run=run)
        assert out.columns == [*df.columns, "n_lines", "n_removed", "n_runs", "n_foreign"]
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute(rows, run)


def test_empty(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_alone(rows, run, words):
    """As ``brute``, but a line of ``words`` or more goes by itself too."""
    seen, out, done = set(), [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None and (i, t) not in done:
            lines, gone = t.split("\n"), set()
            for size in (run, 1):
                for a in range(len(lines) - size + 1):
                    w = tuple(lines[a : a + size])
                    if size == run or len(re.findall(r"[^ \t\n\x0b\f\r]+", lines[a])) >= words:
                        if w in seen:
                            gone.update(range(a, a + size))
                        seen.add(w)
            done[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, done.get((i, t))))
    return sorted(out, key=str)


def test_long_lines_go_alone(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, f"{long} more"), (5, f"e\n{long[:-4]}\nf"), (6, f"g\n{long[:-4]}\nh"), (7, f"{long}\n{long}"), (8, "a"), (9, None), (10, ""), (11, f"a\n{long}"), (11, f"a\n{long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for run in (2, 3):
        out = linededup.dedup_lines(df, run=run, alone=50).collect()
        assert sorted(((r.doc_id, r.text) for r in out), key=str) == brute_alone(rows, run, 50)
        assert {r.doc_id: (r.n_removed, r.n_foreign) for r in out}[3] == (1, 1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(docs, alone=50).collect()), key=str)
    rows = [tuple(r) for r in docs.collect()]
    assert kept == brute_alone(rows, 2, 50) != brute(rows)


def test_very_common_lines(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"start {k}\nsame line\nsame end\n{long}\nown {k % 7}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = linededup.dedup_lines(df, alone=50).select("doc_id", "text").collect()
    assert sorted(map(tuple, out), key=str) == brute_alone(rows, 2, 50)
