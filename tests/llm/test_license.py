from larder.llm import license as lic

from .test_decontam import split


def brute(rows):
    out = []
    for i, t in rows:
        w, found, labels = split(t), [], set()
        for phrase, label in lic.PHRASES.items():
            p = phrase.split()
            at = [a for a in range(len(w)) if w[a : a + len(p)] == p]
            found += at
            labels |= {label} if at else set()
        out.append((i, len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


def base(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lic.scan(docs)
    assert base(got) == brute([tuple(r) for r in docs.collect()])
    assert got.where("labels like '%gpl-3%' and base_labels = ''").count() > 0


def test_odd_rows(spark):
    notice = lic.NOTICES[0][0]
    cut = notice.replace("free of charge ", "")
    rows = [(1, None), (2, ""), (3, "Under the MIT License under the mit-license CC-BY-NC"), (3, "Under the MIT License"), (4, "x"), (4, "x"), (None, "cc by"), (6, "cc by nc " * 20000), (7, "word " + cut.upper()), (8, "under the the mit license"), (9, notice[:40])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, label string, template int")
    got = lic.scan(df)
    assert base(got) == brute(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[7].labels == "mit-text" and 0.7 <= by[7].score < 1 and by[7].base_labels == ""
    assert by[9].labels == "" and by[1].score == 0 and by[6].score == 1 and by[2].labels == ""
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in by.values())


def test_empty(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sql(spark):
    from larder.llm.queries import ORACLES, QUERIES

    from .oracle import same

    assert same(spark, QUERIES["op7_license_scan"], ORACLES["op7_license_scan"], "/root/testdata/sf0.01") == 1000
