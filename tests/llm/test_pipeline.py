import corpus_pipeline
from larder.llm import simhash, toxicity
from larder.llm.queries import read

from .test_decontam import brute as brute_hits
from .test_linededup import brute_alone
from .test_packing import whole

SF = "/root/testdata/sf0.01"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def brute_firsts(rows):
    fps = [(i, simhash.text_fingerprint((t or "").encode(), 5, 42, 4)) for i, t in sorted(rows)]
    radius, group = simhash.radius_for(0.8, 4), {}

    def find(x):
        while group.get(x, x) != x:
            x = group[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= radius:
                group[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i, _ in fps if find(i) == i}


def test_each_stage(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert [*steps] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]

    out = steps["toxicity"](spark, docs, SF).cache()
    bad = {r.doc_id for r in toxicity.toxicity(docs, read(spark, SF, "labels")).collect() if r.predicted}
    assert bad and sorted(pairs(out)) == sorted(p for p in pairs(docs) if p[0] not in bad)
    assert out.columns == columns

    docs, before = out, dict(pairs(out))
    out = steps["line dedup"](spark, docs, SF).cache()
    left = {i: t for i, t in brute_alone(list(before.items()), 2, 50) if t or not before[i]}
    assert sorted(pairs(out)) == sorted(left.items())
    assert out.columns == columns and all(r.n_chars == len(r.text) for r in out.collect())

    docs = out
    out = steps["SimHash near-dedup"](spark, docs, SF).cache()
    firsts = brute_firsts(pairs(docs))
    assert sorted(pairs(out)) == sorted(p for p in pairs(docs) if p[0] in firsts)
    assert out.columns == columns

    docs = out
    out = steps["benchmark decontamination"](spark, docs, SF).cache()
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    dirty = {r[0] for r in brute_hits(pairs(docs), items) if r[-1]}
    assert dirty and sorted(pairs(out)) == sorted(p for p in pairs(docs) if p[0] not in dirty)
    assert out.columns == columns

    rows = steps["best-fit packing"](spark, out, SF).collect()
    assert whole(rows, pairs(out)) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in rows)


def test_line_stage_keeps_what_is_left(spark):
    shared = "\n".join(f"shared line {k} of many words that all have" for k in range(50))
    rows = [(1, shared), (2, f"{shared}\nthe only line of its own"), (3, shared), (4, f"own start\n{shared}\nown end")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.dedup_lines(spark, docs, SF).collect()
    left = {1: shared, 2: "the only line of its own", 4: "own start\nown end"}
    assert {r.doc_id: r.text for r in out} == left and all(r.n_chars == len(r.text) for r in out)
