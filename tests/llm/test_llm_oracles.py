import pytest
from conftest import rows

from quantloom.llm import queries

NAMES = sorted(queries.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
