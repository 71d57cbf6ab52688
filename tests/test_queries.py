import pytest

import __spark_entry__ as entry
from oracle import connect, same

CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CORE)
def test_against_duckdb(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    if name in entry.oracle_sql():
        same(df, con, entry.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
