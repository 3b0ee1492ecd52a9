import pytest
from support import oracle, rows

from millrace.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_equals_sql(spark, folder, name):
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), oracle(catalog.ORACLE_SQL[name], folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
