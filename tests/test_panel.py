"""Functions and operators on small panels: nulls, ties, short windows, empty tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalar as sc
from quantloom.functions import ts, xs
from quantloom.operators import backtest as bt
from quantloom.operators import clean, evaluate, panel, portfolio, regress, risk
from quantloom.plans import factors
from quantloom.sources import files, landing
from quantloom.streaming import ingest

DAY = dt.date(2024, 1, 1)


def frame(spark, values, stock="a"):
    """One stock, a day for each value."""
    return spark.createDataFrame([(DAY + dt.timedelta(i), stock, v) for i, v in enumerate(values)], "ts date, stock string, x double")


def across(spark, values):
    """One day, a stock for each value."""
    return spark.createDataFrame([(DAY, f"s{i:02}", v) for i, v in enumerate(values)], "ts date, stock string, x double")


def got(df, expr, order="ts"):
    return [r["v"] for r in df.withColumn("v", expr).orderBy(order).collect()]


def close(a, b):
    return all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)) for x, y in zip(a, b, strict=True))


def test_returns(spark):
    df = frame(spark, [1.0, 2.0, None, 4.0, 5.0])
    assert close(got(df, ts.daily_return("x")), [None, 1, None, None, 0.25])
    assert close(got(frame(spark, [1.0, 2.0, 4.0]), ts.daily_return("x", -1)), [-0.5, -0.5, None])
    assert close(got(frame(spark, [1.0, 2.0, 4.0]), ts.ts_delta("x", -1)), [-1, -2, None])
    assert close(got(frame(spark, [0.0, 2.0]), ts.daily_return("x")), [None, None])


def test_windows(spark):
    df = frame(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0])
    assert close(got(df, ts.ts_mean("x", 3)), [None, None, 2, None, None, None, 6])
    assert close(got(df, ts.ts_sum("x", 3)), [0, 0, 6, 0, 0, 0, 18])
    assert close(got(df, ts.ts_rank("x", 3)), [None, None, 1, None, None, None, 1])
    assert got(frame(spark, [2.0, 2.0, 2.0]), ts.ts_zscore("x", 3)) == [None] * 3


def test_decay_weighs_the_oldest_most(spark):
    assert close(got(frame(spark, [1.0, 0.0, 0.0, 0.0]), ts.decay("x", 4)), [None, None, None, 0.4])
    assert close(got(frame(spark, [0.0, 0.0, 0.0, 1.0]), ts.decay("x", 4)), [None, None, None, 0.1])
    assert close(got(frame(spark, [0.0, 0.0, 0.0, 1.0]), ts.decay("x", 4, newest_first=True)), [None, None, None, 0.4])


def test_ewm_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=40)
    w = 0.5 ** (np.arange(11, -1, -1) / 5)
    want = [None] * 11 + [float(x[i - 11 : i + 1] @ w / w.sum()) for i in range(11, 40)]
    assert close(got(frame(spark, x.tolist()), ts.ts_ewm_sum("x", 12, 5)), want)


def test_fill(spark):
    df = frame(spark, [None, 1.0, None, None, None])
    assert got(df, ts.ffill("x", 2)) == [None, 1, 1, 1, None]
    assert got(df, ts.ffill("x")) == [None, 1, 1, 1, 1]
    assert got(df, ts.bfill("x")) == [1, 1, None, None, None]


def test_rank_and_quantiles(spark):
    assert close(got(across(spark, [1.0, 1.0, 3.0, None, 2.0]), xs.rank("x"), "stock"), [0.375, 0.375, 1, None, 0.75])
    assert close(got(across(spark, [1.0, 2.0, 3.0, None, 10.0]), xs.winsorize("x"), "stock"), [1.03, 2, 3, None, 9.79])
    assert got(across(spark, [2.0, 2.0, 2.0]), xs.zscore("x"), "stock") == [None] * 3
    assert got(across(spark, [None, None]), xs.rank("x"), "stock") == [None] * 2


def test_scalars(spark):
    df = across(spark, [1.0, None, float("nan"), float("inf")])
    assert got(df, sc.clean("x"), "stock") == [1, None, None, None]
    assert got(df, sc.if_else(F.col("x") > 2, 1.0, 0.0), "stock") == [0, None, 1, 1]
    assert got(across(spark, [850.0, 1800.0, 6020.0, 9999.0, None]), sc.sic_division("x"), "stock") == ["A", None, "H", "J", None]


def test_settings_of_unknown_kind():
    with pytest.raises(ValueError):
        factors.Settings(neutralize="sector")


def test_unknown_factor(spark, sf):
    with pytest.raises(ValueError):
        factors.evaluated(frame(spark, [1.0]), ["nothing"])


def test_library_takes_four_exchanges(spark, sf):
    """However many factors, the plan above the panel deals out four times, and once more for ranks in time."""
    from quantloom.queries import filled

    base = filled(spark, sf)
    lines = lambda df: df._jdf.queryExecution().executedPlan().toString().splitlines()
    count = lambda df: sum("Exchange hashpartitioning" in x for x in lines(df))
    # the panel's own plan ends dealt by stock, which the first steps use
    assert count(factors.evaluated(base, [n for n in factors.FACTORS if n != "mean_reversion_2"], 5)) <= count(base) + 3
    assert count(factors.evaluated(base, None, 5)) <= count(base) + 4


def test_densify_and_empty(spark):
    df = spark.createDataFrame([(DAY, "a", 1.0), (DAY + dt.timedelta(1), "b", 2.0)], "ts date, stock string, x double")
    assert panel.densify(df).count() == 4
    assert panel.densify(df.limit(0)).count() == 0


def test_upsert_takes_whole_dates(spark):
    old = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", 2.0)], "ts date, stock string, x double")
    new = spark.createDataFrame([(DAY, "a", 5.0, 1)], "ts date, stock string, x double, extra int")
    assert [tuple(r) for r in panel.upserted(old, new).collect()] == [(DAY, "a", 5.0, 1)]


def test_exploded_last_keeps_the_last_value(spark):
    df = spark.createDataFrame([(DAY, ["a", "b"], 1, 1.0, 2.0), (DAY, ["a"], 2, None, 3.0)], "ts date, tickers array<string>, seq int, u double, v double")
    assert sorted(map(tuple, panel.exploded_last(df, "tickers", "seq").collect())) == [(DAY, "a", 1.0, 3.0), (DAY, "b", 1.0, 2.0)]
    assert sorted(map(tuple, panel.exploded_last(df, "tickers", "seq", strict=True).collect()))[0] == (DAY, "a", None, 3.0)


def test_universe_by_company(spark):
    df = spark.createDataFrame([(DAY, "a", 1, 5.0), (DAY, "b", 1, None), (DAY, "c", 2, 9.0), (DAY, "d", None, 1.0)], "ts date, stock string, cik int, volume double")
    assert {r.stock: r.in_universe for r in clean.in_universe(df, 1, company="cik").collect()} == {"a": False, "b": False, "c": True, "d": True}


def test_correlation_of_constant_is_null(spark):
    df = across(spark, [0.1, 0.1, 0.1]).withColumn("fwd", F.monotonically_increasing_id().cast("double"))
    assert evaluate.coefficients(df, ["x"]).first()["ic"] is None
    with pytest.raises(ValueError):
        evaluate.with_forward(df, 0)


def test_fits_meet_their_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    y = x @ [1.0, 0.0, -2.0] + 0.5 + rng.normal(size=50) * 0.1
    cov = np.cov(np.column_stack([x, y]).T, ddof=0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(regress.solved(cov, 50), np.linalg.lstsq(xc, yc, rcond=None)[0])
    assert np.allclose(regress.solved(cov, 50, "ridge", 3.0), np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ yc))
    twice = np.cov(np.column_stack([x, x[:, 0], y]).T, ddof=0)  # smallest norm: equal columns share
    assert np.allclose(regress.solved(twice, 50), np.linalg.lstsq(np.column_stack([xc, xc[:, 0]]), yc, rcond=None)[0], atol=1e-6)
    for kind, l1, l2 in (("lasso", 0.1, 0.0), ("elastic_net", 0.05, 0.05)):
        w = regress.solved(cov, 50, kind, 0.1)
        g = xc.T @ (yc - xc @ w) / 50 - l2 * w  # |gradient| <= l1, equal where w isn't 0
        assert np.all(np.abs(g) <= l1 + 1e-6) and np.allclose(g[w != 0], l1 * np.sign(w[w != 0]), atol=1e-6)
    with pytest.raises(ValueError):
        regress.solved(cov, 50, "other")


def test_medians_are_exact(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=20_000), np.where(rng.random(20_000) < 0.6, 0.0, rng.normal(size=20_000))
    df = spark.createDataFrame([(float(x), float(y), None, float(i) if i < 4 else None) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, c double, d double")
    r = regress.medians(df, ["a", "b", "c", "d"]).first()
    assert (r.a, r.b, r.c, r.d) == (np.median(a), np.median(b), None, 1.5)
    assert regress.medians(df.limit(0), ["a"]).first().a is None


def test_prediction_without_a_fit(spark):
    df = frame(spark, [1.0, 2.0])
    fit = spark.createDataFrame([], "const_term double, beta array<double>")
    with pytest.raises(Exception, match="no date was fitted"):
        regress.predicted(df, fit, ["x"]).collect()


def test_per_date_against_one_factor(spark, sf):
    from quantloom.queries import _signal

    df = _signal(spark, sf)
    a = {r.ts: r for r in regress.per_date(df, ["x"]).collect()}
    b = {r.ts: r for r in regress.one_factor(df, "x").collect()}
    assert len(a) > 300
    for k, r in a.items():
        if b[k].beta is not None and b[k].rsquared is not None:
            assert math.isclose(r.beta[0], b[k].beta, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r.rmse, b[k].rmse, rel_tol=1e-6, abs_tol=1e-9)


def test_folds():
    assert regress.folds(10, 4, 2, 2) == [(0, 4, 4, 6), (0, 6, 6, 8), (0, 8, 8, 10)]
    assert regress.folds(10, 4, 2, 2, "rolling")[1] == (2, 6, 6, 8)
    with pytest.raises(ValueError):
        regress.folds(10, 4, 2, 2, "other")


def test_weights_meet_the_optimality_conditions():
    rng = np.random.default_rng(3)
    z, d, mu = rng.normal(size=(60, 5)) * 0.1, rng.uniform(0.01, 0.05, 60), rng.normal(size=60) * 0.05
    cov = z @ z.T + np.diag(d)
    w, left = portfolio.solve(mu, z, d, 2.5, 0.08)
    g = mu - 2.5 * cov @ w
    free = (w > 1e-6) & (w < 0.08 - 1e-6)
    assert left < 1e-9 and math.isclose(w.sum(), 1) and w.min() >= 0 and w.max() <= 0.08 + 1e-12
    assert np.ptp(g[free]) < 1e-6 and g[w <= 1e-6].max(initial=-9) <= g[free].min() + 1e-6 and g[w >= 0.08 - 1e-6].min(initial=9) >= g[free].max() - 1e-6
    assert portfolio.solve(mu, z, d, 2.5, 0.01)[0] is None
    # without bounds the optimum is known in closed form
    w, left = portfolio.solve(mu, z, d, 2.5, short=True)
    inv = np.linalg.inv(cov)
    rest = (inv.sum(1) @ mu - 2.5) / inv.sum()
    assert left < 1e-9 and np.allclose(w, inv @ (mu - rest) / 2.5, atol=1e-7) and w.min() < -0.05
    w, _ = portfolio.solve(mu * 1e6, z, d, 2.5, short=True)
    assert w.min() < -1000  # no bound of its own
    _, left = portfolio.solve(mu, z, d, 2.5, 0.08, rounds=3)
    assert left > portfolio.TOLERANCE


@pytest.mark.parametrize("cap, short", [(0.02, False), (None, False), (0.02, True)])
def test_weights_of_uneven_variances_take_few_rounds(cap, short):
    """Variances that differ a millionfold: a gradient's steps are as short as the largest demands, Newton's aren't."""
    rng = np.random.default_rng(11)
    z, d, mu = rng.normal(size=(1000, 13)) * 30, rng.lognormal(0, 3, 1000) * 100, rng.normal(size=1000) * 0.01
    w, left = portfolio.solve(mu, z, d, 2.5, cap, short, rounds=100)
    g = mu - 2.5 * (z @ (z.T @ w) + d * w)
    low, high = -math.inf if short else 0.0, math.inf if cap is None else cap
    free = (w > low) & (w < high)
    assert left < 1e-14 and math.isclose(w.sum(), 1) and w.min() >= low and w.max() <= high
    price = g[free].mean()
    assert np.allclose(g[free], price, rtol=1e-8) and (g[w <= low] <= price + 1e-8).all() and (g[w >= high] >= price - 1e-8).all()


def test_many_stocks_take_no_square_matrix():
    import tracemalloc

    rng = np.random.default_rng(9)
    z, d, mu = rng.normal(size=(20_000, 51)) * 0.02, rng.uniform(1e-4, 1e-2, 20_000), rng.normal(size=20_000) * 0.01
    tracemalloc.start()
    w, left = portfolio.solve(mu, z, d, 2.5, 0.01)
    low, high = risk.ends(z, np.eye(51), d)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert left <= portfolio.TOLERANCE and math.isclose(w.sum(), 1) and low[1] > 0 and high[0] > 0 and most < 1e9


@pytest.mark.parametrize("low, high", [(0.0, 0.3), (-np.inf, 0.3), (0.0, np.inf), (-np.inf, np.inf), (-0.2, 0.5)])
def test_projection(low, high):
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1.0, 100.0):
        v = rng.normal(size=9) * scale
        p = portfolio.projected(v, low, high)
        assert math.isclose(p.sum(), 1, abs_tol=1e-9) and p.min() >= low - 1e-12 and p.max() <= high + 1e-12
        inner = (p > low + 1e-9) & (p < high - 1e-9)
        shift = v - p
        if inner.any():  # parts that aren't at a bound are all shifted alike, others more or less
            s = shift[inner].mean()
            assert np.allclose(shift[inner], s) and (shift[p <= low + 1e-9] <= s + 1e-9).all() and (shift[p >= high - 1e-9] >= s - 1e-9).all()


def test_covariance_against_numpy(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(DAY + dt.timedelta(i), r.tolist()) for i, r in enumerate(f)], "ts date, f array<double>")
    w = 0.5 ** (np.arange(29, -1, -1) / 63)
    w /= w.sum()
    c = f - w @ f
    want = (c * w[:, None]).T @ c / (1 - w @ w)
    assert np.allclose(risk.square(risk.factor_covariance(df), 3), want)
    assert risk.square(risk.factor_covariance(df.limit(0)), 3) is None
    assert np.allclose(risk.square(risk.factor_covariance(df.limit(1)), 3), np.eye(3))


GROUPS = ("p", "q", "none")


def risk_panel(spark, n=12, days=9):
    rng = np.random.default_rng(5)
    rows = [(DAY + dt.timedelta(t), i, float(100 + rng.normal() * 3), float(rng.normal()) if i or t % 2 else None, "pqx"[i % 3]) for i in range(n) for t in range(days)]
    return spark.createDataFrame(rows, "ts date, stock long, close double, s1 double, industry string"), rows


def plain_model(rows, stocks):
    """Pseudo-inverses, date by date."""
    days = sorted({r[0] for r in rows})
    at = {(r[0], r[1]): r for r in rows}
    fs, es, last = [], [], None
    for before, t in zip(days, days[1:], strict=False):
        x = np.array([[at[t, i][3] or 0.0, *[float(at[t, i][4] == g) for g in GROUPS]] for i in stocks])
        r = np.array([at[t, i][2] / at[before, i][2] - 1 for i in stocks])
        f = np.linalg.pinv(x) @ r
        fs.append(f)
        es.append(r - x @ f)
        last = x
    fs, es = np.array(fs), np.array(es[-21:])

    def weighted(a, hl):
        w = 0.5 ** (np.arange(len(a) - 1, -1, -1) / hl)
        w /= w.sum()
        c = a - w @ a
        return (c * w[:, None]).T @ c / (1 - w @ w)

    return fs, es, last @ weighted(fs, 63) @ last.T + np.diag(np.diag(weighted(es, 21)))


@pytest.mark.parametrize("date, h", [(None, 1), (DAY + dt.timedelta(6), 5)])
def test_covariance_matrix_against_pseudo_inverses(spark, monkeypatch, date, h):
    """Blocks of a few stocks, a group without stocks, stocks without a group."""
    monkeypatch.setattr(risk, "BLOCK", 5)
    df, rows = risk_panel(spark)
    window = 63 if date is None else 4
    if date is not None:
        days = sorted({r[0] for r in rows if r[0] <= date})[-5:]
        rows = [r for r in rows if r[0] in days]
    model = risk.risk_model(df, ["s1"], GROUPS, date, window)
    v = {(r.stock_i, r.stock_j): r.cov for r in risk.covariance_matrix(model, 4, h=h).collect()}
    _, _, want = plain_model(rows, range(12))
    low, high = np.linalg.eigvalsh(want)[[0, -1]]
    want = (np.where(np.eye(12) > 0, want, 0.85 * want) if high > 1e4 * low else want) * h
    assert len(v) == 144 and np.allclose([[v[i, j] for j in range(12)] for i in range(12)], want, rtol=1e-6, atol=1e-12)


def test_residuals_and_exposures_against_pseudo_inverses(spark):
    df, rows = risk_panel(spark)
    f, e = risk.factor_returns(df, ["s1"], GROUPS)
    fs, es, _ = plain_model(rows, range(12))
    assert np.allclose([r.f for r in f.orderBy("ts").collect()], fs)
    got_e = [r.e for r in e.orderBy("ts", "stock").collect()]
    assert np.allclose(np.reshape(got_e, (-1, 12)), es)
    x = {r.stock: r.x for r in risk.exposures(df, ["s1"], GROUPS).collect()}
    assert x[1][1:] == [0.0, 1.0, 0.0] and x[2][1:] == [0.0, 0.0, 0.0]


def test_covariance_without_returns_is_the_identity(spark):
    df, _ = risk_panel(spark, days=1)
    model = risk.risk_model(df, ["s1"], GROUPS)
    v = {(r.stock_i, r.stock_j): r.cov for r in risk.covariance_matrix(model, 4, h=3).collect()}
    assert len(v) == 144 and all(c == float(i == j) for (i, j), c in v.items())


def test_ends_of_a_spectrum():
    rng = np.random.default_rng(6)
    for n, k, least, rank in ((5, 2, 1e-3, 2), (200, 10, 1e-4, 10), (300, 4, 1e-13, 4), (50, 6, 1e-2, 2), (3, 5, 1.0, 5)):
        x, b = rng.normal(size=(n, k)), rng.normal(size=(k, rank))
        fm, d = b @ b.T, rng.uniform(least, 1.0, n)
        d[0] = d[-1]  # equal ones
        want = np.linalg.eigvalsh(x @ fm @ x.T + np.diag(d))
        low, high = risk.ends(x, fm, d)
        assert low[0] * (1 - 1e-6) <= want[0] <= low[1] * (1 + 1e-6) and high[0] * (1 - 1e-6) <= want[-1] <= high[1] * (1 + 1e-6)
        assert math.isclose(low[0], low[1], rel_tol=1e-6) and math.isclose(high[0], high[1], rel_tol=1e-6)


def test_conditioning_over_stocks(spark):
    rng = np.random.default_rng(8)
    x, fm = rng.normal(size=(40, 3)), np.diag([1.0, 0.5, 0.0])
    for d in (rng.uniform(0.5, 1, 40), rng.uniform(1e-3, 1, 40), np.full(40, 1e-13), rng.uniform(0.02, 1, 40)):
        ev = np.linalg.eigvalsh(x @ fm @ x.T + np.diag(d))
        rows = spark.createDataFrame([(a.tolist(), float(v)) for a, v in zip(x, d, strict=True)], "x array<double>, var double").repartition(5)
        for worst in (50.0, 1e3, 1e4):
            assert risk.badly_conditioned(rows, fm, worst) == bool(ev[0] <= 1e-12 or ev[-1] / ev[0] > worst)
    assert not risk.badly_conditioned(rows.limit(0), fm)


def test_optimized_and_held(spark):
    df, _ = risk_panel(spark)
    model = risk.risk_model(df, ["s1"], GROUPS)
    pred = df.select("ts", "stock", F.coalesce("s1", F.lit(0.0)).alias("prediction"))
    w = portfolio.optimized(pred, model, 4, interval=3, cap=0.3).toPandas()
    assert w["ts"].nunique() == 3 and len(w) == 36 and set(w["status"]) == {"solved"} and w["residual"].max() <= portfolio.TOLERANCE
    assert all(math.isclose(g["weight"].sum(), 1) and g["weight"].max() <= 0.3 + 1e-9 for _, g in w.groupby("ts"))
    equal = portfolio.optimized(pred.withColumn("prediction", F.lit(1e-9)), model, 4, interval=3).toPandas()
    assert np.allclose(equal["weight"], 1 / 12) and set(equal["status"]) == {"none"} and equal["residual"].isna().all()
    # stocks without a prediction count with 0; dates without any are left out
    first = df.agg(F.min("ts")).first()[0]
    few = portfolio.optimized(pred.where("stock < 4").withColumn("prediction", F.when(F.col("ts") != first, F.lit(-1.0))), model, 4, interval=3).toPandas()
    assert few["ts"].nunique() == 2 and len(few) == 24 and few[few["stock"] < 4]["weight"].max() < 1e-9
    assert set(portfolio.optimized(pred, model, 4, interval=3, cap=0.01).toPandas()["status"]) == {"capped"}
    weights = spark.createDataFrame(w[["ts", "stock", "weight"]])
    kept = portfolio.held(weights, df, 3).toPandas()
    assert len(kept) == 108 and not kept["weight"].isna().any()
    short = portfolio.held(weights, df, 2).toPandas()
    assert short["weight"].isna().sum() == 36


def test_tuners_against_plain_fits(spark):
    rng = np.random.default_rng(7)
    rows = [(DAY + dt.timedelta(t), float(a), float(b), float(a - 0.5 * b + rng.normal()) if (t + i) % 7 else None) for t in range(20) for i, (a, b) in enumerate(rng.normal(size=(8, 2)))]
    df = spark.createDataFrame(rows, "ts date, a double, b double, fwd double")
    full = [r for r in rows if r[3] is not None]

    def errors(inside, alpha):
        out = []
        for seen, held in inside:
            x, y = (np.array([r[1:3] for r in seen]), np.array([r[3] for r in seen]))
            xc = x - x.mean(0)
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ (y - y.mean()))
            c = y.mean() - x.mean(0) @ w
            e = [np.array([r[3] for r in part]) - c - np.array([r[1:3] for r in part]) @ w for part in (seen, held)]
            out.append(((e[0] ** 2).mean(), (e[1] ** 2).mean(), np.abs(e[1]).mean()))
        return np.array(out)

    day = lambda r: (r[0] - DAY).days
    five = [([r for r in full if day(r) * 5 // 20 != k], [r for r in full if day(r) * 5 // 20 == k]) for k in range(5)]
    for r in regress.kfold_tuned(df, ["a", "b"]).collect():
        assert math.isclose(r.val_mse, errors(five, r.alpha)[:, 1].mean(), rel_tol=1e-9)
    for how, first in (("expanding", lambda e: 0), ("rolling", lambda e: e - 8)):
        walk = [([r for r in full if first(e) <= day(r) < e], [r for r in full if e <= day(r) < e + 4]) for e in range(8, 17, 3)]
        got_ = regress.walk_forward_tuned(df, ["a", "b"], 8, 4, 3, how=how).collect()
        assert sum(r.best for r in got_) == 1
        for r in got_:
            e = errors(walk, r.alpha)
            want = (e[:, 0].mean(), e[:, 1].mean(), e[:, 2].mean(), np.sqrt(e[:, 1]).mean(), np.sqrt(e[:, 1]).std())
            assert np.allclose((r.train_mse, r.val_mse, r.val_mae, r.val_rmse, r.val_rmse_sd), want)


def test_covered_and_modelled(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0), (None, None)], "a double, b double")
    assert evaluate.covered(df, ["a", "b"], 0.5) == ["a"] and evaluate.covered(df.limit(0), ["a"], 0.5) == []


def test_industry_ranges_file(spark, tmp_path):
    (tmp_path / "r.txt").write_text(" 1 Agric  Agriculture\n          0100-0199 Crops\n          0800-0899 Forestry\n 2 Mines  Mining\n          0800-1099 Metal\n")
    r = files.read_industry_ranges(spark, str(tmp_path / "r.txt"))
    df = spark.createDataFrame([(1, 850), (2, 1000), (3, 5), (4, None)], "stock int, sic_code int")
    assert {x.stock: x.industry for x in risk.industries(df, r).collect()} == {1: "Agric", 2: "Mines", 3: "Other", 4: "Other"}


def test_wide_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("attribute,close,close,volume\nstock,a,b,a\n2024-01-02,1,2,\n2024-01-03,x,4,7\n")
    got_rows = {(str(r.ts), r.stock): (r.close, r.volume) for r in files.read_panel(spark, str(tmp_path / "p.csv")).collect()}
    assert got_rows == {("2024-01-02", "a"): (1, None), ("2024-01-02", "b"): (2, None), ("2024-01-03", "a"): (None, 7), ("2024-01-03", "b"): (4, None)}
    with pytest.raises(ValueError):
        files.read_panel(spark, "p.json")


def test_columns_and_stocks(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0]).select("x", "stock", "ts", F.col("x").alias("close"), F.col("x").alias("open"))
    assert panel.ordered(df).columns == ["ts", "stock", "close", "open", "x"]
    assert panel.ordered(df.drop("x")).columns == ["ts", "stock", "open", "close"]
    with pytest.raises(ValueError, match="volume"):
        panel.require(df, "close", "volume")
    two = df.unionByName(df.limit(2).withColumn("stock", F.lit("b")))
    assert [r.stock for r in panel.common_stocks(panel.split_dates(two, 0.5, 0.25, 0.25), ["x"]).collect()] == ["a"]
    wide = panel.by_stock(two, "x", ["a", "b"]).orderBy("ts").collect()
    assert [(r.a, r.b) for r in wide] == [(1.0, 1.0), (2.0, 2.0), (3.0, None), (4.0, None)]
    known = panel.known_attributes([df.select("ts", "stock", "open"), df.select("ts", "stock", "x")], ("x", "low", "open"))
    assert known.columns == ["ts", "stock", "x", "open"] and known.count() == 8


def test_places(spark):
    df = spark.createDataFrame([(f"s{i:03}",) for i in range(50, 0, -1)], "stock string")
    assert [r.place for r in panel.numbered(df, "stock").orderBy("stock").collect()] == list(range(1, 51))
    assert panel.numbered(df.limit(0), "stock").count() == 0


def test_written_files(spark, tmp_path):
    df = frame(spark, [1.0, 2.0])
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 2
    path = str(tmp_path / "h")
    assert files.read_horizon(spark, path, 1) is None
    files.write_horizon(df, path, 1)
    files.write_horizon(df.limit(1), path, 5)
    files.write_horizon(df.withColumn("x", F.col("x") + 1), path, 1)
    assert sorted(r.x for r in files.read_horizon(spark, path, 1).collect()) == [2.0, 3.0]
    assert files.read_horizon(spark, path, 5).count() == 1
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="bad.parquet|Parquet"):
        files.read_or_empty(spark, str(tmp_path / "bad.parquet"), "x double").count()


def test_factor_cache_grows(spark, tmp_path):
    """What is added equals a full run, is computed from no more than what the factors reach, and leaves the rest as it was."""
    from quantloom.queries import filled
    from quantloom.streaming import snapshot

    names = ["mean_reversion_5", "mean_reversion_2", "liquidity_barra", "short_term_reversal_barra"]
    df = filled(spark, "/root/testdata/sf0.001").drop("sic_code").cache()
    days = sorted(r.ts for r in df.select("ts").distinct().collect())
    full = {(r.ts, r.stock): r for r in factors.evaluated(df, names, 5).collect()}
    for end in (200, 203, 203, len(days)):
        kept = factors.grown(df.where(F.col("ts") <= F.lit(days[end - 1])), str(tmp_path), "p", names, 5).collect()
        assert len(kept) == end * 10
        for r in kept:
            for n in names:
                a, b = r[n], full[r.ts, r.stock][n]
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    assert any(r[n] is not None for r in kept for n in names)
    table = next(tmp_path.glob("factors-*"))
    assert snapshot.version(spark, str(table)) == 3  # nothing new, nothing written
    last = snapshot._current(snapshot._Store(spark, str(table)))[1]["versions"]
    assert sorted(map(len, last.values())) == [3, len(days) - 203, 200]
    reach = max(x.reach for x in factors.expressions(names, 5).values())
    assert 50 < reach < 130 and factors.expressions(["mean_reversion_0"])["mean_reversion_0"].reach == 1 + 251 + 3
    assert files.cache_key("p", ["x"], scale=5) != files.cache_key("p", ["x"], scale=6)
    assert files.read_or_empty(spark, str(tmp_path / "none"), "ts date, stock string").count() == 0
    # a past that isn't asked for isn't read
    late = df.where(F.col("ts") >= F.lit(days[-reach - 6]))
    rows = factors.evaluated(late, names, 5).where(F.col("ts") > F.lit(days[-6])).collect()
    for r in rows:
        for n in names:
            a, b = r[n], full[r.ts, r.stock][n]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_backtest_by_hand(spark):
    p = spark.createDataFrame([(DAY + dt.timedelta(i), s, c) for s, cs in (("a", [10.0, 11.0, 11.0]), ("b", [20.0, 20.0, 30.0])) for i, c in enumerate(cs)], "ts date, stock string, close double")
    w = spark.createDataFrame([(DAY, "a", 1.0), (DAY + dt.timedelta(1), "b", 3.0)], "ts date, stock string, weight double")
    r = bt.run(p, panel.densify(w.unionByName(p.select("ts", "stock").withColumn("weight", F.lit(None).cast("double")))).groupBy("ts", "stock").agg(F.max("weight").alias("weight"))).orderBy("ts").collect()
    assert len(r) == 2
    assert math.isclose(r[0].gross, 0.1) and math.isclose(r[0].turnover, 1) and math.isclose(r[0].cost, 500 + 1300)
    e = 1e6 * (1 + 0.1 - 1800 / 1e6)
    assert math.isclose(r[1].equity, e) and math.isclose(r[1].gross, 0.5) and math.isclose(r[1].turnover, 2)
    assert math.isclose(r[1].cost, e * (0.005 / 11 + 0.005 / 20) + 2 * e * 13 / 1e4)


def test_gate_by_notional_against_a_plain_fold(spark, sf):
    from quantloom.queries import filled, weighted

    p, w = filled(spark, sf), weighted(spark, sf)
    a = bt.run(p, w, bt.Config(holding_period=3, least_trade=0.001)).orderBy("ts").collect()
    b = bt.run(p, w, bt.Config(holding_period=3, least_trade=0.001, least_notional=1e-9)).orderBy("ts").collect()
    assert len(a) == len(b) > 300
    for x, y in zip(a, b, strict=True):
        assert math.isclose(x.net, y.net, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(x.turnover, y.turnover, abs_tol=1e-9)
    none = bt.run(p, w, bt.Config(least_notional=1e12)).collect()
    assert all(r.turnover == 0 and r.net == 0 for r in none)


def test_landed_files(spark, tmp_path):
    (tmp_path / "bars.json").write_text('{"ticker": "a", "open": 1, "close": 2, "timestamp": 1704153600000}\n{"ticker": "a", "open": 1, "close": 3, "timestamp": 1704153600001, "otc": true}\n{"ticker": null}\n')
    r = landing.daily_bars(spark, str(tmp_path / "bars.json")).collect()
    assert [(str(x.ts), x.stock, x.close, x.volume) for x in r] == [("2024-01-02", "a", 3.0, None)]
    (tmp_path / "st.json").write_text('{"filing_date": "2024-02-01", "tickers": ["a", "b"], "timeframe": "annual", "seq": 1, "ebitda": 5}\n{"filing_date": "2024-02-01", "tickers": ["a"], "timeframe": "annual", "seq": 2, "net_income": 7}\n{"filing_date": "2024-02-01", "tickers": ["a"], "timeframe": "quarterly", "seq": 3, "ebitda": 9}\n')
    got_rows = {x.stock: (x.ebitda, x.net_income) for x in landing.statements(spark, str(tmp_path / "st.json")).collect()}
    assert got_rows == {"a": (5.0, 7.0), "b": (5.0, None)}
    (tmp_path / "t.json").write_text('{"ticker": "a", "type": "CS"}\n')
    assert landing.ticker_details(spark, str(tmp_path / "t.json")).first().market_cap == 0


def test_small_trades_are_left_out(spark):
    w = spark.createDataFrame([(DAY + dt.timedelta(i), "a", v) for i, v in enumerate([0.5, 0.5003, 0.5006, 0.0004])], "ts date, stock string, weight double")
    assert [r.traded for r in bt.gated(w, 0.0005).orderBy("ts").collect()] == [0.5, 0.5, 0.5006, 0.0004]


def test_weights_are_held_stock_by_stock(spark):
    """A stock that the last date with weights left out is held beside it."""
    day = lambda i: DAY + dt.timedelta(i)
    w = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "b", None), (day(1), "a", None), (day(1), "b", 1.0), (day(2), "a", None), (day(2), "b", None), (day(3), "a", None), (day(3), "b", None)], "ts date, stock string, weight double")
    got_ = {(r.ts, r.stock): r.weight for r in bt.hold(w, 3).collect()}
    assert [got_[day(i), s] for i in range(4) for s in "ab"] == [1.0, None, None, 1.0, 1.0, 1.0, None, 1.0]
    assert [r.weight for r in bt.hold(w, 1).orderBy("ts", "stock").collect()] == [1.0, None, None, 1.0, None, None, None, None]


def test_gate_and_least_charges_against_plain_folds(spark):
    rng = np.random.default_rng(12)
    rows = [(DAY + dt.timedelta(i), s, float(rng.choice([0.0, 0.0004, 0.01, 0.2, 0.2003]))) for s in "abc" for i in range(40)]
    w = spark.createDataFrame(rows, "ts date, stock string, weight double").repartition(7)
    got_ = {(r.stock, r.ts): r.traded for r in bt.gated(w, 0.0005).collect()}
    for s in "abc":
        now = 0.0
        for ts, _, v in sorted(r for r in rows if r[1] == s):
            now = v if abs(v - now) >= 0.0005 else now
            assert got_[s, ts] == now
    p = spark.createDataFrame([(DAY + dt.timedelta(i), s, float(rng.uniform(5, 5000))) for s in "abc" for i in range(41)], "ts date, stock string, close double")
    t = bt.trades(p, bt.prepared(w.where("weight > 0")), 0.0)
    lots = {}
    for r in t.collect():
        lots.setdefault(r.ts, []).append(r)
    run = bt.run(p, w.where("weight > 0"), bt.Config(least_trade=0.0, capital=1e4)).orderBy("ts").collect()
    some = [0, 0]
    for r in run:
        fees = [abs(x.dw) * r.equity / x.price * 0.005 for x in lots[r.ts] if x.dw]
        some = [some[0] + sum(f < 1 for f in fees), some[1] + sum(f > 1 for f in fees)]
        want = sum(max(1.0, f) for f in fees) + sum(abs(x.dw) * x.bps / 1e4 for x in lots[r.ts]) * r.equity
        assert math.isclose(r.cost, want, rel_tol=1e-9)
    assert min(some) > 5


def test_totals_of_weights(spark):
    day = lambda i: DAY + dt.timedelta(i)
    w = spark.createDataFrame([(day(0), "a", 0.5), (day(0), "b", 0.5), (day(1), "a", 0.4), (day(2), "a", 0.4), (day(2), "b", 1.0), (day(3), "a", 1e-7), (day(4), "a", None)], "ts date, stock string, weight double")
    assert [(r.ts, r.state) for r in bt.totals(w).orderBy("ts").collect()] == [(day(0), "one"), (day(1), "under"), (day(2), "over"), (day(3), "zero")]
    with pytest.warns(RuntimeWarning, match="1 dates"):
        assert bt.warned(w) == 1
    with pytest.raises(Exception, match="add up to 0"):
        bt.prepared(w).collect()
    assert bt.prepared(w, tolerance=1e-9).where("ts = date'2024-01-05'").count() >= 0
    assert sorted(r.weight for r in bt.prepared(w, unit_sum=False).collect()) == [0.0, 1e-7, 0.4, 0.4, 0.5, 0.5, 1.0]
    assert [r.bps for r in bt.slippage(w, ((1, 3.0),), 9.0).orderBy("stock").collect()] == [3.0, 9.0]


def test_weights_that_add_up_to_nothing(spark):
    w = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", -1.0)], "ts date, stock string, weight double")
    with pytest.raises(Exception, match="add up to 0"):
        bt.prepared(w).collect()


def test_stream_of_bars(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.event_bars(ingest.landed(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, ingest.event_bars(events).collect()))
