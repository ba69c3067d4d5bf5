"""Every registered query of the core library against its SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from footfall.plans import CATALOGUE
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for m in CATALOGUE for n, q in m.QUERIES.items()}
SQL = {n: s for m in CATALOGUE for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours) > 0
    if name in SQL:
        assert_same(ours, con.execute(SQL[name]).df())


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.count() == 5
    assert set(SQL) <= set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
