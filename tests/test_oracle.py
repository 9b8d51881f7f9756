"""Every driver query against its SQL on the smallest data."""

from pathlib import Path

import pytest
from check_oracle import difference, duck, load_entry

from changelens.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
ENTRY = load_entry()
QUERIES, SQL = queries.as_callables(), oracle.statements()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, con.sql(SQL[name]).df()) == ""


def test_entry_runs(spark):
    df = ENTRY.entry(spark)
    assert df.columns[:3] == ["repo", "module", "language"] and df.count() > 0
