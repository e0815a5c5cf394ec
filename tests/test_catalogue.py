import pytest

from scriptloom.plans.catalogue import ORACLES, QUERIES
from tests.harness import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = rows_of(QUERIES[name](spark, SF))
    assert rows
    if name in ORACLES:
        assert rows == rows_of_sql(ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
