"""Every registered query against its DuckDB text, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert df.count() > 0
        return
    names, extra, missing = oracle.compare(df, duck, ORACLES[name])
    assert not names
    assert not extra and not missing, (list(extra.items())[:3], list(missing.items())[:3])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
