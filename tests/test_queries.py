import pytest

import kinweave.plans  # noqa: F401
from kinweave.plans import registry
from tests.same import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    got = spark_rows(df)
    if name in registry.ORACLE:
        assert got == duck_rows(duck, registry.ORACLE[name])
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["passage_id", "source_id", "title", "locator", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
