import pytest

from workload.compare import compare, connect
from workload.registry import oracles, queries

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_statement(spark, con, name):
    assert name in ORACLES
    rows, problems = compare(spark, con, name, QUERIES[name], ORACLES[name], SMALL)
    assert not problems, problems


def test_flagship_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
