"""Every registered query against DuckDB on the same tables."""

import pytest

from compare import connect, differences
from tremorline.verification import catalogue

QUERIES = catalogue.build()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


# Long series need more events than the smallest tables have.
LONG_DIR = "/root/testdata/sf0.01"
LONG = [n for n, q in QUERIES.items() if q.sql and "_long" in n]


@pytest.mark.parametrize("name", LONG)
def test_long_series_match_sql(spark, name):
    query = QUERIES[name]
    frame = query.run(spark, LONG_DIR)
    assert not frame.isEmpty()
    assert differences(frame, connect(LONG_DIR), query.sql) == []


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql and n not in LONG])
def test_matches_sql(spark, sf_dir, duck, name):
    query = QUERIES[name]
    assert differences(query.run(spark, sf_dir), duck, query.sql) == []


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, sf_dir, name):
    frame = QUERIES[name].run(spark, sf_dir)
    assert len(set(frame.columns)) == len(frame.columns)
    frame.collect()
