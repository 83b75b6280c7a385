"""Every registered query runs; where it has a SQL form, DuckDB gives the same rows."""

import pytest
from compare import duck, same

from cairnmap.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, name):
    assert same(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
