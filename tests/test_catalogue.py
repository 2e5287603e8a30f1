"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import SF, by_duckdb, by_spark

from quern.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert by_spark(QUERIES[name](spark, SF)) == by_duckdb(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
