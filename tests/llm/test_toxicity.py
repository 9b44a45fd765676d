import math
import zlib

import pytest

from larder.llm import toxicity


def test_separates_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == docs.count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    known = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    bad, fine = [s for s, y in known if y], [s for s, y in known if not y]
    auc = sum((b > f) + 0.5 * (b == f) for b in bad for f in fine) / (len(bad) * len(fine))
    assert auc > 0.97
    assert sum(s >= 0.5 for s in bad) > 0.75 * len(bad) and sum(s >= 0.5 for s in fine) <= 0.01 * len(fine)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "awful idiot", 1), (3, "x " * 100000, 1), (None, "fine words", 1), (4, "İ é!", 1), (4, "İ é!", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, 1), (2, 0, 1), (None, 1, 1), (3, 7, 1), (4, 0, 1), (99, 1, 1)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_features_ignore_neighbours_in_batch():
    for texts in (["a bb ccc", "", "long wordings here", "bb"], ["z"]):
        docs, found = toxicity.features(texts)
        for k, t in enumerate(texts):
            assert sorted(found[docs == k]) == sorted(toxicity.features([t])[1])


def plain_ftrl(rows, passes, bits, alpha, beta, l1, l2):
    """The update of one coordinate at a time, as the method's paper has it; (z, n) by feature, the bias beside them."""
    bias, z, n = 1 << bits, {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= (0 if i == bias else l1):
            return 0.0
        pull = z[i] - math.copysign(0 if i == bias else l1, z[i])
        return -pull / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for _, text, label in sorted(rows):
            seen = [*sorted(set(toxicity.features([text], bits)[1].tolist())), bias]
            w = {i: weight(i) for i in seen}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label  # beyond 35 a double holds 0 or 1
            for i in seen:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w[i]
    return {i: weight(i) for i in z if weight(i)}


def test_plain_ftrl(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    rows = [(r.doc_id, docs[r.doc_id] or "", int(r.toxic)) for r in labels if r.doc_id in docs]
    rows += [(10**6 + k, f"{'vile wretch' if k % 3 == 0 else 'kind friend'} number {k % 11}", int(k % 3 == 0)) for k in range(60)]
    how = {"alpha": 1.0, "beta": 1.0, "l1": 0.5, "l2": 0.1}
    got = toxicity.fit(spark.createDataFrame(rows, "key long, text string, label int"), passes=3, bits=14, **how)
    want = plain_ftrl(rows, 3, 14, **how)
    assert len(want) > 20 and got == pytest.approx(want, abs=1e-9)
