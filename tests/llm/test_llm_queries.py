import zlib
from collections import Counter

import pytest

import corpus_pipeline
from offerlake.llm import decontam
from offerlake.llm.oracles import ORACLES
from offerlake.llm.queries import QUERIES
from tests.compare import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = connection(SF).sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_language_held_out(spark):
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    want = dict(connection("/root/testdata/sf0.01").sql("select doc_id, lang from documents").fetchall())
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d in want if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(want[d] == p for d, p in zip(held.doc_id, held.lang_pred, strict=True)) / len(held) > 0.97


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
        assert after.count() >= 0.5 * before.count(), name
        before = after
    assert decontam.contamination_report(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    words = Counter()
    for r in before.collect():
        w = r["text"].lower().split()
        words.update({" ".join(w[i : i + 60]) for i in range(len(w) - 59)})
    assert not [w for w, n in words.items() if n > 1]
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert set(columns) <= set(last.columns)
    assert corpus_pipeline.ORACLE_SQL is None
