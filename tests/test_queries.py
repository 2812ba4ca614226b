"""Every registered query against its DuckDB twin on the smallest data; those of the subpackage llm have tests of their own."""

import re

import pytest

import __spark_entry__ as contract
from civicspark.plans.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)))
def test_query(spark, con, name):
    message = compare(QUERIES[name](spark, FOLDER), con, ORACLES.get(name))
    assert message.startswith("ok"), message


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 150
    assert "closest_pollingLocation$name" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
