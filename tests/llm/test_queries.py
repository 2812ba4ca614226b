"""The registered queries on small data, and the pipeline against its parts."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from civicspark.llm.queries import ORACLES, QUERIES
from civicspark.plans.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    message = compare(QUERIES[name](spark, FOLDER), duck(FOLDER), ORACLES[name])
    assert message.startswith("ok"), message


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, FOLDER)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept.collect())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(tuple(r) for r in out)
    by_start = sorted(out, key=lambda r: r.start)
    assert [r.start for r in by_start] == [sum(r.n_tokens for r in by_start[:i]) for i in range(len(by_start))]
