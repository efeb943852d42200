from __future__ import annotations

import re

import pytest

import corpus_pipeline
from probewise.llm import store

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = store.kept(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_stages_keep_the_columns_of_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near-duplicates", "benchmark", "secrets", "packing"]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.dtypes == before.dtypes


def test_near_duplicates_leave_one_of_each_text(stages):
    before, after = stages["near-duplicates"]
    assert after.count() == after.select("text").distinct().count()
    assert before.select("text").distinct().count() >= after.count()


def test_benchmark_passages_go(spark, stages):
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda df: {r.doc_id for r in df.collect() if any(i in " ".join(re.findall(r"\w+", r.text.lower())) for i in items)}
    before, after = stages["benchmark"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert holds(before) and not holds(after) and ids(before) - ids(after) == holds(before)


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    assert after.count() == before.count()
    assert before.where("text rlike '(?i)token = .[0-9a-f]{40}'").count() > 0
    assert after.where("text rlike '(?i)token = .[0-9a-f]{40}'").count() == 0


def test_packing_takes_every_document(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
