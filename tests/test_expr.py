"""Nested expressions against NumPy and plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import expr as e
from quantloom.plans import factors

DAY = dt.date(2020, 1, 1)


def series(spark, values):
    rows = [(DAY + dt.timedelta(i), s, None if v is None else float(v)) for s, x in values.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "ts date, stock string, x double")


def columns(df, *names):
    """name -> stock -> values in order of time."""
    out = {n: {} for n in names}
    for r in sorted(df.collect(), key=lambda r: (r.stock, r.ts)):
        for n in names:
            out[n].setdefault(r.stock, []).append(r[n])
    return out


def data():
    rng = np.random.default_rng(4)
    jump = list(rng.normal(size=150))
    jump[40:43] = [1e13, 1e13, 1e13]
    gone = list(rng.normal(5, 1e-3, size=150))
    gone[30] = None
    nan = list(rng.normal(size=150))
    nan[20] = float("nan")
    return {"jump": jump, "gone": gone, "nan": nan, "flat": [2.0] * 150, "short": [1.0, 2.0]}


@pytest.mark.parametrize("w", [1, 2, 7, 60, 61])
def test_long_windows_against_numpy(spark, w):
    given = data()
    weights = 0.5 ** (np.arange(w)[::-1] / 5.0)
    got = columns(e.computed(series(spark, given), {"s": e.sum_("x", w, None), "m": e.mean("x", w), "d": e.std("x", w), "e": e.ewm("x", w, 5.0)}), "s", "m", "d", "e")
    for stock, x in given.items():
        for i in range(len(x)):
            part = x[max(0, i - w + 1) : i + 1]
            for name in "smde":
                v = got[name][stock][i]
                if len(part) < w or None in part or (name == "d" and w == 1):
                    assert v is None, (name, stock, i)
                    continue
                a = np.array(part)
                want = {"s": a.sum(), "m": a.mean(), "d": a.std(ddof=1) if w > 1 else None, "e": (a @ weights) / weights.sum()}[name]
                if math.isnan(want):
                    assert math.isnan(v)
                else:  # relative to the largest value of the window, and of no other
                    assert abs(v - want) <= 1e-12 * max(np.abs(a).max(), 1e-3), (name, stock, i, v, want)


def test_values_that_have_left_leave_no_trace(spark):
    x = [1e13, 1e13, 1e13] + [0.1] * 200
    got = columns(e.computed(series(spark, {"a": x}), {"m": e.mean("x", 60), "d": e.std("x", 60)}), "m", "d")
    assert got["m"]["a"][-1] == pytest.approx(0.1, abs=1e-15) and got["d"]["a"][-1] == pytest.approx(0, abs=1e-15)


@pytest.mark.parametrize("chunk", [8, 4096])
def test_ranks_in_time(spark, chunk, monkeypatch):
    monkeypatch.setattr(e, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    given = {s: [None if rng.random() < 0.03 else float(rng.integers(0, 9)) for _ in range(n)] for s, n in (("a", 100), ("b", 37), ("c", 3))}
    given["c"][1] = float("nan")
    got = columns(e.computed(series(spark, given), {f"r{w}": e.rank_in_time("x", w) for w in (1, 2, 5, 13)}), "r1", "r2", "r5", "r13")
    for w in (1, 2, 5, 13):
        for s, x in given.items():
            for i, v in enumerate(x):
                part = x[max(0, i - w + 1) : i + 1]
                bad = w < 2 or len(part) < w or any(p is None or p != p for p in part)
                assert got[f"r{w}"][s][i] == (None if bad else sum(p < v for p in part) / (w - 1))


def test_a_nested_factor_is_the_library_s(spark):
    from quantloom.queries import filled

    df = filled(spark, "/root/testdata/sf0.01")
    own = factors.settled(-e.rank(e.zscore(e.returns("close"), 252)), factors.LIBRARY)
    a = {(r.ts, r.stock): r.v for r in e.computed(df, {"v": own}).collect()}
    b = {(r.ts, r.stock): r.mean_reversion_0 for r in factors.evaluated(df, ["mean_reversion_0"]).collect()}
    assert a == b and any(v is not None for v in a.values())
    exchanges = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(e.computed(df, {"v": own})) <= exchanges(df) + 3


def test_own_factors_are_registered(spark, sf):
    from quantloom.queries import filled

    @factors.factor(decay=1, neutralize=None)
    def own_test_factor(scale):
        return e.delta("close", 5 // scale) / e.c("close")

    try:
        df = factors.evaluated(filled(spark, sf), ["own_test_factor", "mean_reversion_5"], keep=("close",))
        assert df.columns == ["ts", "stock", "close", "own_test_factor", "mean_reversion_5"] and df.where("own_test_factor is not null").count() > 0
    finally:
        del factors.FACTORS["own_test_factor"]


def test_equal_parts_are_made_once():
    steps = e._Steps()
    steps.place(e.mean("x", 50) + e.mean("x", 50) / e.std("x", 50) + e.mean("x", 5) * e.mean("x", 5))
    names = [n.key[1] for nodes in steps.made.values() for n in nodes]
    assert names.count("lag 49") == 3 and len(names) == len(set(names)) + 2  # lags of different parts
    with pytest.raises(TypeError):
        e.c("x") == 1  # noqa: B015
    with pytest.raises(ValueError):
        e.ewm("x", 1000, 1.0)


def test_cells(spark):
    df = series(spark, {"a": [1.0, 0.0, None, -4.0]})
    x = e.c("x")
    made = {"a": 2 - x * 3 + 1, "b": 1 / x, "c": e.abs_(-x) ** 2, "d": e.indicator(x < 0), "e": e.both(x > 0, x), "f": e.or_zero(x), "g": e.some(x), "h": e.cell("twice", lambda v: v * 2, x)}
    got = columns(e.computed(df, made), *made)
    assert {k: v["a"] for k, v in got.items()} == {
        "a": [0.0, 3.0, None, 15.0], "b": [1.0, None, None, -0.25], "c": [1.0, 0.0, None, 16.0], "d": [0.0, 0.0, 0.0, 1.0],
        "e": [1.0, None, None, None], "f": [1.0, 0.0, 0.0, -4.0], "g": [1.0, None, None, -4.0], "h": [2.0, 0.0, None, -8.0],
    }
    assert e.computed(df.limit(0), made).count() == 0
    assert e.computed(df.withColumn("y", F.lit(1)), {"z": e.rank("x")}, ("y",)).columns == ["ts", "stock", "y", "z"]


def test_windows_copy_few_columns(spark, sf):
    """Columns of all windows of the library together: 3076 where each copies all that the others made."""
    from quantloom.queries import SCALES, filled

    found = []

    def walk(node):
        if node.nodeName() == "Window":
            found.append(node.output().size())
        below = node.children()
        for i in range(below.size()):
            walk(below.apply(i))

    walk(factors.evaluated(filled(spark, sf), None, SCALES)._jdf.queryExecution().optimizedPlan())
    assert sum(found) < 1600
