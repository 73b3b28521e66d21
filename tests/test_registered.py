"""Every registered query against its SQL, on the smallest tables."""

import pytest

from siltbed.plans import registry

from .compare import same
from .conftest import SF


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
