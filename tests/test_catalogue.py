"""Every registered query of the library against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL, normal
from weftline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    ours = normal(catalogue.QUERIES[name](spark, SMALL).toPandas())
    assert ours == normal(duck.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["i", "j", "sim"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
