"""Every query outside the optional subpackage runs; those with SQL give its rows."""

import pytest

from quillon.plans import catalogue

from compare import DATA, connection, same

QUERIES = {n: q for m in catalogue.modules() for n, q in m.QUERIES.items()}
SQL = {n: s for m in catalogue.modules() for n, s in m.ORACLE.items()}
con = connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(name, spark):
    same(QUERIES[name], SQL[name], spark, con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
