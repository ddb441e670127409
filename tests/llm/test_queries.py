"""Registered text queries against their SQL."""

import pytest

from compare import connect, differences
from tremorline.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name]) == []
