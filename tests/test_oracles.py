"""Every registered query against its SQL; queries without SQL must give rows."""

import pytest

from callweave import registry

from .compare import SF, difference, duck


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, con, name):
    assert difference(registry.queries()[name](spark, SF), registry.oracle_sql()[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
