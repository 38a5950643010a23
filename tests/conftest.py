import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quantloom.session import local_session

    s = local_session(4, 4, **{"spark.sql.warehouse.dir": "/tmp/spark-warehouse-tests"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def views(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def duck():
    return views(SF)


@pytest.fixture(scope="session")
def larger_duck():
    return views("/root/testdata/sf0.01")


def rows(df):
    """Sorted rows of a pandas frame: columns by name, floats to six places."""
    import datetime
    import math

    df = df[sorted(df.columns)]

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return None
        if isinstance(x, (datetime.date, datetime.datetime)):
            return str(x)[:19].removesuffix(" 00:00:00")
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, str):
            return x
        return round(float(x), 6) + 0.0

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=lambda r: [(x is not None, str(type(x)), x) for x in r])
