"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import connect, difference

from runledger.workloads import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, SF, name, QUERIES[name], ORACLES.get(name)) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["run_number", "type", "n", "good"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
