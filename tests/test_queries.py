import pytest

from sqlcheck import differences
from tidemark.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, data, name):
    assert not differences(spark, data, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NAMES)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
