"""The pipeline's stages on a small table."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillsift.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = staged(stage(spark, docs, SF))
    return out


def test_columns_stay(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_decisions_take_effect(stages):
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in stages.items()}
    names = ["documents", *(n for n, _ in corpus_pipeline.STAGES)]
    for before, after in zip(names, names[1:]):
        assert ids[after] <= ids[before]
    assert len(ids["quality_classifier"]) < len(ids["documents"])
    assert ids["packing"] == ids["mixing"]


def test_good_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.filter("quality = 1").join(stages["documents"], "doc_id").select("doc_id")
    kept = good.join(stages["quality_classifier"], "doc_id", "left_semi").count()
    assert kept > 0.95 * good.count()


def test_mixture_repeats_rows(stages):
    most = stages["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most == 2


def test_packed_tokens_are_the_mixture(stages):
    got = stages["packing"].filter("piece = 0").groupBy("doc_id").count().collect()
    want = stages["mixing"].groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {r.doc_id: r["count"] for r in want}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
    assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
