"""Every named query against its SQL twin on the small tables."""

from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module
from workload import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    assert difference(df, con, entry_module.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.SQL)
