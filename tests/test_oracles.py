import pytest

from tallyspark.plans import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[:2] == ["entity", "figure"] and df.count() > 0
