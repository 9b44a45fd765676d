"""Operators that hand rows on keep every input column, whatever its name."""

import corpus_pipeline
import pytest
from larder.llm import decontam, linededup, simhash, staging, toxicity
from larder.llm.words import free

NAMES = """
    _id _hash _own _ones _foreign_ones _lines _gone _other _before _key _bad _first _text _t id text_hash hash key bad first other lines gone elsewhere starts foreign ones foreign_ones of_id of_hash
    salt mark mark_at w1 w2 at size codes n_removed n_lines n_runs n_foreign n_chars_ picked k h left near n fp more words fingerprint component_id root node least row score label present batch
    contaminated items n_words n_hit held_out predicted
""".split()
LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [(1, f"a\n{LONG}\nb", 3), (2, f"c\n{LONG}\nd", 3), (3, "x y z", 5), (3, "x y z", 5), (4, None, None), (5, "", 0), (None, "p q r s t", 9), (6, "own start zero one two three four five six seven eight nine ten eleven twelve", 9)]


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long")
    for n, name in enumerate(NAMES):
        docs = docs.withColumn(name, docs.doc_id * 100 + n) if name not in docs.columns else docs
    return docs.withColumn("dotted.name", docs.doc_id + 7).cache()


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 7)], "doc_id long, quality int, toxic int")
    return items, labels


def whole(out, wide):
    assert out.columns[: len(wide.columns)] == wide.columns
    rows = out.collect()
    for r in rows:
        for n, name in enumerate(NAMES):
            assert r[wide.columns.index(name)] == (None if r.doc_id is None else r.doc_id * 100 + n), name
        assert r["dotted.name"] == (None if r.doc_id is None else r.doc_id + 7)
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_line_dedup(wide):
    out = linededup.dedup_lines(wide, alone=50)
    assert out.columns[-4:] == ["n_lines_", "n_removed_", "n_runs_", "n_foreign_"]
    assert (2, "c\nd") in whole(out, wide) and out.count() == len(ROWS)
    assert (2, "c\nd") in whole(linededup.without_repeats(wide, length_col="n_chars"), wide)


def test_keep_one(wide):
    assert len(whole(simhash.keep_one(wide), wide)) == 5


def test_drop_contaminated(wide, tables):
    assert [i for i, _ in whole(decontam.drop_contaminated(wide, tables[0]), wide)] == [1, 2, 3, 3, 4, 5, None]


def test_drop_toxic(wide, tables):
    whole(toxicity.drop_toxic(wide, tables[1]), wide)
    none = tables[1].where("false")
    assert len(whole(toxicity.drop_toxic(wide, none), wide)) == len(ROWS)


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, wide, empty, monkeypatch, tables):
    monkeypatch.setattr(corpus_pipeline, "read", lambda s, d, t: dict(benchmark=tables[0], labels=tables[1])[t])
    docs = wide.where("false") if empty else wide
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = whole(step(spark, docs, ""), wide)
        assert not empty or out == [], name
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert len(packed) == (0 if empty else len(ROWS))


def test_free_names():
    assert free("key", ["a"]) == "key" and free("key", ["KEY", "key_"]) == "key__"


def test_staged_tables_go(spark):
    import os

    with staging.scope() as paths:
        df = staging.stage(spark.range(3), "numbers")
    assert df.count() == 3 and len(paths) == 1 and os.path.isdir(paths[0].removeprefix("file:"))
    staging.remove(spark, paths)
    assert not os.path.exists(paths[0].removeprefix("file:"))
