import pytest
from colloquy import registry

from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, sf_dir, con, name):
    compare(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name])
