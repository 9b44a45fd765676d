import hashlib
import re

from larder.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, seen = split(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    seen |= windows[g]
        out.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("items").collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sum(r[-1] for r in want) > 5
    assert got(decontam.contamination(docs, items)) == want
    assert got(decontam.contamination(docs, items, broadcast_rows=0)) == want
    kept = decontam.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if not r[-1])


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30))
    items = [(1, long), (2, "Short one"), (3, None), (4, "..."), (5, "a a a a a a a a a a a a a a"), (11, long), (None, "seven words are in this short item")]
    docs = [(1, None), (2, ""), (3, "x short ONE y"), (4, long[:40] + " " + long), (4, long), (4, long), (None, "z " * 100 + long[10:90]), (7, "a " * 40), (8, "é" + long), (9, "Seven words are, in this short item!"), (10, "w " * 60000 + "short-one")]
    item_df = spark.createDataFrame([(*x, 1) for x in items], "item_id int, text string, doc_id int")
    doc_df = spark.createDataFrame([(*x, 0, "n") for x in docs], "doc_id long, text string, item int, n string")
    assert got(decontam.contamination(doc_df, item_df)) == brute(docs, [("" if i is None else i, t) for i, t in items])
    assert decontam.drop_contaminated(doc_df, item_df).columns == doc_df.columns


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert got(decontam.contamination(docs, items)) == brute([(1, "a b")], [])
    assert got(decontam.contamination(docs.limit(0), items)) == []


def test_sql(spark):
    from larder.llm.queries import ORACLES, QUERIES

    from .oracle import same

    assert same(spark, QUERIES["op5_decontaminate"], ORACLES["op5_decontaminate"], "/root/testdata/sf0.01") == 1000
