import pytest
from conftest import same

from driftline.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_kernel_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(0 < r.drift_pct < 15 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())
