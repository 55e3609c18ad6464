"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import assert_same
from tests.conftest import SF_SMALL

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("qid", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, qid):
    got = QUERIES[qid](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[qid]).fetchdf()
    assert_same(got, want)


@pytest.mark.parametrize("qid", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, qid):
    df = QUERIES[qid](spark, SF_SMALL)
    assert df.count() > 0


def test_every_query_has_a_docstring():
    for qid, fn in QUERIES.items():
        assert fn.__doc__, qid


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "target" in df.columns
