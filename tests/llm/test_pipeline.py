"""The stages on small documents, and the queries with their SQL."""

import math
import os

import pytest

import __spark_entry__
import compare
import corpus_pipeline
from tarnkit.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_the_columns_and_pass_awkward_rows(spark, documents, tmp_path):
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes, name
    assert docs.count() > 0


def test_stages_on_no_documents(spark, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, "").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_stages_on_the_test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    begun = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["language"]) == set(begun)
    judged = [k for k in kept["language"] if labels.get(k) == 1 and len(begun[k]["text"].split()) >= 60]
    assert sum(k in kept["quality"] for k in judged) >= 0.98 * len(judged)
    assert len(set(kept["near_duplicates"].values())) == len(kept["near_duplicates"])
    assert set(kept["repeated_passages"]) == set(kept["near_duplicates"])
    assert all(len(x) <= len(kept["near_duplicates"][k]) for k, x in kept["repeated_passages"].items())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    result = __spark_entry__.queries()[name](spark, FOLDER).toPandas()
    assert len(result) > 0
    check = __spark_entry__.oracle_sql().get(name)
    if check:
        problem = compare.differences(result, compare.connect(FOLDER).sql(check).df())
        assert problem is None, problem


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_pipeline_packs_everything(spark):
    rows = __spark_entry__.queries()["pipeline"](spark, FOLDER)
    used = rows.groupBy("sequence_id").agg({"length": "sum"}).collect()
    total = sum(r[1] for r in used)
    assert max(r[1] for r in used) <= 2048 and len(used) <= math.ceil(total / 2048) + 3
