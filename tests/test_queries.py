"""Every query with SQL gives DuckDB's rows; the others run and have rows."""

import pytest

from lodestone import catalog
from tests.conftest import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert compare(spark, [name], catalog.QUERIES, catalog.ORACLES, sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert [r["split"] for r in e.entry(spark).orderBy("position").collect()] == ["train", "validation", "test"]
    assert set(e.oracle_sql()) <= set(e.queries())
