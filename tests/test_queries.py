"""Every query of the library against its SQL."""

import oracle
import pytest

from weftline.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, name):
    oracle.compare(registry.queries()[name](spark, data), SQL[name], data)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
