"""Every registered query against its SQL twin on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck
from waymark.plans.registry import load_all

SMALL = "/root/testdata/sf0.001"
# Error pages only appear once there are enough orders for a fourth page.
EMPTY_WHEN_SMALL = {"landed_rejects"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query_matches_sql(spark, con, name):
    q = load_all()[name]
    problem = difference(q.run(spark, SMALL), con, q.sql)
    assert problem is None or (name in EMPTY_WHEN_SMALL and problem == "no rows"), problem


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["facet", "key", "count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
