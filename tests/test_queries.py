import pytest

from readloom.plans import queries

from . import oracle
from .conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = oracle.both(spark, duck, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
