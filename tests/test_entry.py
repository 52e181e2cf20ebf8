import pytest

import __spark_entry__ as entry
from skyloom.plans import general, oracle, registry
from tests.oracle import connection, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES = {**registry.QUERIES, **general.QUERIES}
SQL = {**oracle.SQL, **general.SQL}


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(con, SQL[name])


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p4_found", "p5_found"} <= set(entry.queries())
