"""Every query with SQL gives that SQL's rows."""

import pytest
from conftest import rows

from quantloom import oracles, queries

ORACLES = oracles.oracle_sql()
#: Ten stocks of ten industries leave nothing to regress on styles, and no factor that is neutral by industry: these take the next larger tables.
LARGER = {"factor_returns_pinv", "factor_residuals", "factor_covariance", "specific_variance", "factor_engine", "covariance_matrix", "covariance_matrix_as_of", "optimize_equal_weight_fallback"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, larger_duck, name):
    sf, duck = ("/root/testdata/sf0.01", larger_duck) if name in LARGER else (sf, duck)
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["covariance_matrix", "covariance_matrix_as_of"])
def test_drawn_matrices(spark, tmp_path, name):
    """400 stocks whose matrices are badly conditioned: both sides draw them to their diagonals."""
    import duckdb

    duck, sf = duckdb.connect(), "/root/testdata/sf0.1"
    for t, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")):
        duck.sql(f"copy (from '{sf}/{t}.parquet' where {key} between 500 and 899) to '{tmp_path}/{t}.parquet'")
        duck.sql(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    got, want = queries.queries()[name](spark, str(tmp_path)).toPandas(), duck.sql(ORACLES[name]).df()
    ((bad,),) = duck.sql(ORACLES[name].rsplit(" select stock_i, stock_j", 1)[0] + " select bad from jd").fetchall()
    assert bad and len(got) == 160_000 and rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries.queries())
