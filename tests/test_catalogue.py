import oracle
import pytest

import __spark_entry__ as entry
from ravelin.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, name):
    got = oracle.spark_rows(catalogue.QUERIES[name](spark, SF))
    assert got[1]
    if name in catalogue.ORACLES:
        assert got == oracle.sql_rows(catalogue.ORACLES[name], SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())
