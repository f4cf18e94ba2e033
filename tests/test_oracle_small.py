"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from tests.conftest import SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "turns"]
    assert df.count() > 0
