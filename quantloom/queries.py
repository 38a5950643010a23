"""One query for each operator, over panels derived from the order tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import scalar as sc
from quantloom.functions import expr, ts, xs
from quantloom.operators import backtest as bt
from quantloom.operators import clean, evaluate, panel, portfolio, regress, risk
from quantloom.plans import factors
from quantloom.plans.factors import FACTORS, Settings, evaluated, finished, modelled
from quantloom.session import shared_folder, written
from quantloom.sources import connector, files, fixture
from quantloom.streaming import ingest, snapshot

#: The panel has 357 weeks: the windows of 504 and 1260 days are counted in rows of five days. All others are kept in rows.
SCALES = {"momentum_barra": 5, "value_barra": 5}
STYLE = ["s1", "s2"]
FACTOR_NAMES = [*STYLE, *risk.INDUSTRIES]
Query = Callable[[SparkSession, str], DataFrame]


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros. Exact halves are drawn up
    first, so that noise in the last bits of a double doesn't decide them."""
    return df.select(*[(F.round(F.col(c) * 1.00000000001, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def raw(s: SparkSession, d: str) -> DataFrame:
    return fixture.weekly_panel(s, d)


def filled(s: SparkSession, d: str) -> DataFrame:
    return fixture.weekly_panel(s, d, filled=True)


def bars(s: SparkSession, d: str) -> DataFrame:
    return fixture.weekly_bars(s, d)


def column(source: Query, v: Callable[[], Column]) -> Query:
    """ts, stock, v."""
    return lambda s, d: r6(source(s, d).select("ts", "stock", v().alias("v")))


def _signal(s: SparkSession, d: str) -> DataFrame:
    """close, x: a short reversal signal on the filled panel, and fwd."""
    df = filled(s, d).withColumns({"hl": F.col("high") - F.col("low"), "fwd": ts.forward_return("close")})
    df = df.withColumn("b", sc.ratio(ts.ts_delta("close", 5), ts.ts_mean("hl", 5)))
    return df.withColumn("x", -F.pow(xs.rank("b", 9) - 0.5, F.lit(3.0)))


def _styles(s: SparkSession, d: str) -> DataFrame:
    """Filled panel with fwd, two style exposures and industry (of 49)."""
    df = filled(s, d).withColumns({"fwd": ts.forward_return("close"), "m": ts.ts_mean("close", 20), "ret": ts.daily_return("close")})
    df = df.withColumns({"dev": sc.ratio(F.col("close"), F.col("m")) - 1, "vol": ts.ts_std("ret", 20)})
    return risk.industries(df.withColumns({"s1": xs.zscore("dev"), "s2": xs.zscore("vol")}), fixture.industry_ranges(s))


def _settings(df: DataFrame, s: Settings) -> DataFrame:
    df = df.withColumn("z", -(sc.ratio(F.col("close"), ts.ts_mean("close", 5)) - 1))
    return r6(finished(df, {"z": s}).select("ts", "stock", "z"))


def scan_panel(s, d):
    return r6(bars(s, d))


def densify(s, d):
    return r6(raw(s, d).select("ts", "stock", *fixture.PRICES, "operating_income", "total_liabilities", "sic_code", "cik", "sec_type"))


def calendar_reindex(s, d):
    b = bars(s, d)
    return r6(panel.reindexed(b.select("ts", "stock", "close"), panel.calendar_days(b)))


def unpivot_long(s, d):
    return r6(panel.unpivoted(raw(s, d).select("ts", "stock", "close", "volume", "vwap")))


def pivot_wide(s, d):
    names = ["close", "volume", "vwap"]
    return r6(panel.pivoted(panel.unpivoted(raw(s, d), names), names))


def split_dates(s, d):
    return panel.split_dates(raw(s, d)).select("ts", "stock", "split")


def slice_stock(s, d):
    return r6(panel.slice_stock(raw(s, d), 7).select("ts", "stock", "close"))


def drop_all_null_dates(s, d):
    return r6(panel.filled_dates(raw(s, d).select("ts", "stock", ts.daily_return("close", 26).alias("fwd"))))


def incomplete_dates(s, d):
    return panel.incomplete_dates(raw(s, d).select("ts", "stock", "close", "volume"))


def upsert_latest_date(s, d):
    """The last month comes again, for every other stock and at twice the price."""
    b = bars(s, d).select("ts", "stock", "close")
    recent = F.broadcast(b.agg(F.date_sub(F.max("ts"), 30).alias("t")))
    new = b.join(recent, F.col("ts") >= F.col("t")).where("stock % 2 = 0").select("ts", "stock", (F.col("close") * 2).alias("close"))
    return r6(panel.upserted(b, new))


def union_by_name(s, d):
    b = bars(s, d)
    return r6(b.select("ts", "stock", "close").unionByName(b.select("ts", "stock", "volume"), allowMissingColumns=True))


def anti_join_new_dates(s, d):
    return panel.new_dates(bars(s, d), fixture.benchmark(s, d))


def stride_dates(s, d):
    return r6(panel.every(raw(s, d), 5).select("ts", "stock", "close"))


def explode_tickers_last(s, d):
    line = F.col("l_linenumber")
    f = fixture.table(s, d, "lineitem").select(
        F.date_trunc("month", "l_shipdate").cast("date").alias("ts"),
        F.array("l_suppkey", F.col("l_suppkey") + 1).alias("tickers"),
        F.struct((F.col("l_orderkey") * 8 + line).alias("seq"), F.when(line % 3 > 0, F.col("l_quantity")).alias("q"), F.when(line % 2 == 0, F.col("l_extendedprice")).alias("e")).alias("seq"),
        F.when(line % 3 > 0, F.col("l_quantity")).alias("net_income"),
        F.when(line % 2 == 0, F.col("l_extendedprice")).alias("ebitda"),
    )
    return panel.exploded_last(f, "tickers", "seq")


def nan_handling(s, d):
    return r6(clean.without_sparse(raw(s, d).select("ts", "stock", "close", "volume"), 0.19))


def _types(s, d):
    return raw(s, d).select("stock", F.col("sec_type").alias("type")).distinct()


def semi_join_common_stock(s, d):
    return r6(clean.of_type(raw(s, d).select("ts", "stock", "close"), _types(s, d)))


def top_n_ticker(s, d):
    return r6(clean.masked(clean.in_universe(raw(s, d).select("ts", "stock", "close", "volume"), 5)).select("ts", "stock", "in_universe", "close"))


def top_n_cik(s, d):
    return clean.in_universe(raw(s, d), 4, company="cik").select("ts", "stock", "in_universe")


def clean_data(s, d):
    return r6(clean.cleaned(raw(s, d).select("ts", "stock", "close", "volume"), _types(s, d), n=5))


def asof_rf(s, d):
    return r6(panel.asof(bars(s, d), fixture.risk_free(s, d), "rf"))


def asof_benchmark(s, d):
    return r6(panel.asof(bars(s, d), fixture.benchmark(s, d), "close"))


def sic_division(s, d):
    return raw(s, d).select("stock", "sic_code", sc.sic_division("sic_code").alias("division")).distinct()


def industry_ranges(s, d):
    return risk.industries(raw(s, d).select("stock", "sic_code").distinct(), fixture.industry_ranges(s))


def common_stocks(s, d):
    """Returns over 58 rows leave two rows of the first split: stocks that weren't traded then are out."""
    df = raw(s, d).withColumn("r", ts.daily_return("close", 58))
    return panel.common_stocks(panel.split_dates(df, 0.17, 0.03, 0.8), ["r"])


def attribute_set(s, d):
    """Two statements' attributes, those that are known."""
    a = raw(s, d).select("ts", "stock", "operating_income", "cik")
    b = raw(s, d).select("ts", "stock", "total_liabilities", "sec_type")
    return r6(panel.known_attributes([a, b], ("total_liabilities", "net_income", "operating_income")))


def factor_engine(s, d):
    """A reversal, and a value factor whose 1260 rows the panel doesn't have: its coverage drops it."""
    return r6(modelled(filled(s, d), ["mean_reversion_5", "value_barra"]))


def ffill_limit(s, d):
    return r6(raw(s, d).select("ts", "stock", ts.ffill("close", 2).alias("filled")))


def first_usable_date(s, d):
    return panel.first_usable_date(raw(s, d), ["close"], 0.8)


def settings_default(s, d):
    return _settings(filled(s, d), Settings())


def settings_decay1(s, d):
    return _settings(filled(s, d), Settings(neutralize="industry", decay=1))


def safe_settings_no_sic(s, d):
    return _settings(filled(s, d).drop("sic_code"), Settings(neutralize="sub_industry"))


def estimated_market_cap(s, d):
    df = filled(s, d).withColumn("cap_latest", F.col("diluted_shares_outstanding") * 2)
    return r6(panel.estimated_cap(df).select("ts", "stock", (F.col("est_cap") / 1e6).alias("est_cap")))


def rsi(s, d):
    df = filled(s, d).withColumn("c", ts.ts_delta("close", 1))
    df = df.withColumns({"g": sc.clip(F.col("c"), low=F.lit(0.0)), "l": sc.clip(-F.col("c"), low=F.lit(0.0))})
    return r6(df.select("ts", "stock", ts.rsi("g", "l").alias("v")))


def rsi_strict(s, d):
    df = filled(s, d).withColumn("c", ts.ts_delta("close", 1))
    df = df.withColumns({"g": F.when(F.col("c") > 0, F.col("c")), "l": F.when(F.col("c") < 0, -F.col("c"))})
    return r6(df.select("ts", "stock", ts.rsi("g", "l").alias("v")))


def all_factors(s, d):
    """The whole library in one plan; momentum_barra and value_barra as in SCALES."""
    return r6(evaluated(filled(s, d), scale=SCALES))


def long_windows(s, d):
    """Windows of a year: mean, deviation, weighed mean and ranks in time, as nested expressions."""
    x = {"m252": expr.mean("close", 252), "s252": expr.std("close", 252), "w252": expr.ewm("close", 252, 63.0)}
    x |= {f"r{w}": expr.rank_in_time("close", w) for w in (60, 252, 504)}
    return r6(expr.computed(filled(s, d), x))


def user_factor(s, d):
    """A factor as its user writes it."""
    return r6(expr.computed(filled(s, d), {"v": -expr.rank(expr.zscore(expr.returns("close"), 252))}))


def factor_cache_grows(s, d):
    """A factor of the first 250 weeks, kept; then of all, of which the rest is computed from as far back as it reaches."""
    folder, df = _top(s, "cache"), filled(s, d)
    first = panel.numbered_dates(df).where("rn < 250").select("ts")
    factors.grown(df.join(F.broadcast(first), "ts", "left_semi"), folder, "weekly", ["liquidity_test"])
    return r6(factors.grown(df, folder, "weekly", ["liquidity_test"]).withColumnRenamed("liquidity_test", "z"))


def _ic(s, d):
    return evaluate.coefficients(_signal(s, d), ["x"])


def ic_1d(s, d):
    return r6(_ic(s, d).select("ts", "ic", "n"))


def rank_ic(s, d):
    return r6(_ic(s, d).select("ts", "rank_ic", "n"))


def icir_summary(s, d):
    return r6(evaluate.summary(_ic(s, d)))


def icir_intervals(s, d):
    return r6(evaluate.across_intervals(_signal(s, d), ["x"]).select("interval", "ic_mean", "icir", "n_dates"))


def coverage_filter(s, d):
    return r6(evaluate.coverage(raw(s, d), ["close", "sic_code"]))


def impute_medians(s, d):
    return r6(regress.imputed(raw(s, d).select("ts", "stock", "close"), ["close"]))


def _fit1(s, d):
    return regress.one_factor(_signal(s, d), "x")


def ols_1factor(s, d):
    return r6(_fit1(s, d).select("ts", "const_term", "beta", "rsquared", "n_obs"))


def predict_returns(s, d):
    df = _signal(s, d)
    fit = regress.one_factor(df, "x").withColumn("beta", F.array("beta"))
    return r6(regress.predicted(df, fit, ["x"]))


def _per_date(kind: str, alpha: float = 1.0) -> Query:
    def query(s, d):
        fit = regress.per_date(_styles(s, d), STYLE, kind=kind, alpha=alpha)
        return r6(fit.select("ts", "const_term", *[F.get("beta", F.lit(i)).alias(f"beta_{c}") for i, c in enumerate(STYLE)], "rsquared", "adj_rsquared", "rmse", "n_obs"))

    return query


def results_by_horizon(s, d):
    """Fits for holding periods of 1 and 5 rows, written; those of 5 read back."""
    folder = _top(s, "results")
    df = _signal(s, d)
    for h in (1, 5):
        files.write_horizon(regress.one_factor(df.withColumn("fwd", ts.forward_return("close", h)), "x"), folder, h)
    return r6(files.read_horizon(s, folder, 5).select("ts", "const_term", "beta", "rsquared", "n_obs"))


def weights_by_horizon(s, d):
    folder = _top(s, "weights")
    files.write_horizon(weighted(s, d), folder, 1)
    files.write_horizon(staggered(s, d), folder, 30)
    return r6(files.read_horizon(s, folder, 30).select("ts", "stock", "weight"))


def kfold_tune(s, d):
    return r6(regress.kfold_tuned(_styles(s, d), STYLE))


def walk_forward_splits(s, d):
    return regress.walk_forward_folds(bars(s, d), 200, 50, 50)


def walk_forward_tune(s, d):
    return r6(regress.walk_forward_tuned(_styles(s, d), STYLE, 200, 50, 50))


def ewma_weights(s, d):
    return r6(risk.ewma_weights(bars(s, d), 63.0))


def factor_returns_pinv(s, d):
    f, _ = risk.factor_returns(_styles(s, d), STYLE)
    return r6(f.select("ts", F.posexplode("f").alias("k", "f")).where("abs(f) > 1e-9"))


def factor_residuals(s, d):
    return r6(risk.factor_returns(_styles(s, d), STYLE)[1])


def factor_covariance(s, d):
    return r6(risk.factor_covariance(risk.factor_returns(_styles(s, d), STYLE)[0]).where("abs(cov) > 1e-9"))


def specific_variance(s, d):
    return r6(risk.specific_variance(risk.factor_returns(_styles(s, d), STYLE)[1]))


def industry_exposures(s, d):
    """Exposures of the last date: styles, and one of 49 industries."""
    x = risk.exposures(_styles(s, d), STYLE)
    return r6(x.select("stock", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(FACTOR_NAMES)]))


def _model(s, d, date=None):
    return risk.risk_model(_styles(s, d), STYLE, date=date)


def _covariance(s, d, date=None, h: int = 1) -> DataFrame:
    """In ten thousandths, for the derived prices jump."""
    v = risk.covariance_matrix(_model(s, d, date), len(FACTOR_NAMES), h=h)
    return r6(v.withColumn("cov", F.col("cov") / 1e4))


def covariance_matrix(s, d):
    return _covariance(s, d)


def covariance_matrix_as_of(s, d):
    """The matrix of the 63 weekly returns up to a date, for a holding of 5 rows."""
    return _covariance(s, d, "1999-06-28", 5)


def _weights(s, d, **options):
    df = written(_styles(s, d).select("ts", "stock", "close", "industry", *STYLE))  # the panel is evaluated once
    pred = df.select("ts", "stock", (-F.col("s1") * 0.01).alias("prediction")).where("prediction is not null")
    return portfolio.optimized(pred, risk.risk_model(df, STYLE), len(FACTOR_NAMES), interval=30, **options)


def optimize_weights(s, d):
    return _weights(s, d, cap=0.2)


def optimize_equal_weight_fallback(s, d):
    """No weights fit so small a cap."""
    return r6(_weights(s, d, cap=1e-6).select("ts", "stock", "weight", "status"))


def weighted(s, d):
    return fixture.volume_weights(raw(s, d))


def staggered(s, d):
    return fixture.staggered_weights(raw(s, d))


def hold_weights(s, d):
    """Dates with weights lie two apart and each leaves stocks out, so holding for four tells stocks from dates."""
    return r6(bt.hold(staggered(s, d), 4))


def prepare_weights(s, d):
    return r6(bt.prepared(staggered(s, d), 4))


def held_weights(s, d):
    """Weights of every fifth date, kept until the next one."""
    w = weighted(s, d).where("weight is not null")
    return r6(portfolio.held(w, bars(s, d), 5))


def slippage_tiers(s, d):
    return bt.slippage(bars(s, d), ((4, 13.0), (40, 20.0), (80, 50.0)), 70.0)


def weight_totals(s, d):
    """Totals of weights that are held, halved in February and doubled in March."""
    scaled = F.col("weight") * F.when(F.month("ts") == 2, 0.5).when(F.month("ts") == 3, 2.0).otherwise(1.0)
    return r6(bt.totals(staggered(s, d).withColumn("weight", scaled), 4))


def unscaled_weights(s, d):
    """Weights as they are, without scaling."""
    return r6(bt.prepared(staggered(s, d), 4, unit_sum=False))


def _daily(s, d):
    return bt.daily(bt.trades(filled(s, d), bt.prepared(weighted(s, d), 3)))


def gross_return(s, d):
    return r6(_daily(s, d).select("ts", "gross"))


def turnover(s, d):
    return r6(_daily(s, d).select("ts", "turnover"))


def _free(s, d):
    """Returns without costs, a hundredth of each: the derived prices jump."""
    g = F.col("gross") * 0.01
    return _daily(s, d).select("ts", g.alias("gross"), g.alias("net"), "turnover")


def equity_drawdown(s, d):
    return r6(bt.equity_curve(_free(s, d)).select("ts", "equity", "drawdown"))


def metrics_ungated(s, d):
    return r6(bt.metrics(_free(s, d)))


def benchmark_metrics(s, d):
    r = _free(s, d)
    return r6(bt.benchmark_metrics(r, panel.asof(r, fixture.benchmark(s, d), "close")))


def report_metrics(s, d):
    return r6(bt.report(bt.equity_curve(_free(s, d))))


def plot_series(s, d):
    r = bt.equity_curve(_free(s, d))
    return r6(bt.plotted(r, panel.asof(r, fixture.benchmark(s, d), "close")))


def weight_summary(s, d):
    per = weighted(s, d).where("weight is not null").groupBy("ts").agg(F.count("weight").alias("n"), F.max("weight").alias("m"))
    return r6(per.agg(F.min("n").alias("min_held"), F.max("n").alias("max_held"), F.avg("m").alias("mean_largest"), F.stddev_samp("m").alias("sd_largest")))


def backtest_gated_costs(s, d):
    """On prices drawn together a thousandfold (the derived ones jump); money in millions."""
    calm = filled(s, d).withColumn("close", 900 + F.col("close") * 0.001)
    run = bt.run(calm, weighted(s, d), bt.Config(holding_period=3))
    return r6(run.select("ts", "gross", "net", "turnover", (F.col("cost") / 1e6).alias("cost"), (F.col("equity") / 1e6).alias("equity")))


def event_bars(s, d):
    return r6(ingest.event_bars(fixture.table(s, d, "events")))


def _top(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def stream_upsert(s, d):
    """Bars that land twice, those of January with other prices first, read as a stream into a snapshot."""
    top = _top(s, "stream")
    b = bars(s, d).select("ts", "stock", "close")
    schema = "ts date, stock long, close double"
    b.withColumn("close", F.col("close") + 1).where("month(ts) = 1").write.parquet(f"{top}/landing/one")
    ingest.upsert_stream(ingest.landed(s, f"{top}/landing/one", schema), f"{top}/table", f"{top}/log").awaitTermination()
    b.write.mode("append").parquet(f"{top}/landing/one")
    ingest.upsert_stream(ingest.landed(s, f"{top}/landing/one", schema), f"{top}/table", f"{top}/log").awaitTermination()
    return r6(snapshot.read(s, f"{top}/table", schema))


def snapshot_as_of(s, d):
    """Weeks of the last two months come again at twice the price; then the table as it was before, beside what it is."""
    table, schema = f"{_top(s, 'snapshot')}/table", "ts date, stock long, close double"
    b = bars(s, d).select("ts", "stock", "close")
    first = snapshot.upsert(b, table)
    recent = F.broadcast(b.agg(F.date_sub(F.max("ts"), 60).alias("t")))
    snapshot.upsert(b.join(recent, F.col("ts") >= F.col("t")).select("ts", "stock", (F.col("close") * 2).alias("close")), table)
    then, now = snapshot.read(s, table, schema, first), snapshot.read(s, table, schema)
    return r6(then.join(now.withColumnRenamed("close", "now"), ["ts", "stock"]))


def stream_out_of_order(s, d):
    """Returns since the bar before of bars that come in three runs, weeks mixed; some come with a wrong price first."""
    top = _top(s, "ordered")
    b = bars(s, d).select("ts", F.col("stock").cast("string").alias("stock"), "close", F.lit(2).cast("long").alias("seq"), F.pmod(F.weekofyear("ts") * 7, F.lit(3)).alias("k"))
    for k in range(3):
        wrong = b.where((F.col("k") == (k + 1) % 3) & (F.day("ts") < 8)).select("ts", "stock", F.col("close") + 1, F.lit(1).cast("long"))
        b.where(F.col("k") == k).drop("k").union(wrong).write.mode("append").parquet(f"{top}/landing")
        ingest.ordered_stream(ingest.landed(s, f"{top}/landing", "ts date, stock string, close double, seq long"), f"{top}/table", f"{top}/log").awaitTermination()
    return r6(snapshot.read(s, f"{top}/table", ingest.ORDERED).select("ts", F.col("stock").cast("long").alias("stock"), "close", "ret"))


def _landings(s, d) -> list[tuple[DataFrame, str]]:
    """Batches as a fetcher lands them, in folders by day: January with other prices, then all."""
    b = bars(s, d).select("ts", F.concat(F.lit("S"), "stock").alias("ticker"), *fixture.PRICES, (F.unix_date("ts").cast("long") * 86400000).alias("timestamp"))
    first = b.withColumn("close", F.col("close") + 1).where("month(ts) = 1")
    return [(rows.repartition(8, "ts"), name) for rows, name in ((first, "1"), (b, "2"))]


def landed_bars(s, d):
    """Bars of the years from 1995 on; the condition keeps other days' files closed."""
    path = _top(s, "landed")
    for rows, name in _landings(s, d):
        rows.write.partitionBy("ts").json(f"{path}/{name}")
    return r6(connector.latest_bars(connector.landed(s, "bars", path).where("ts >= date'1995-01-01'")))


def landed_bars_stream(s, d):
    """The same files by a stream that is started for each batch, kept in a snapshot."""
    top, schema = _top(s, "landed"), "ts date, stock string, close double"
    for rows, name in _landings(s, d):
        rows.write.partitionBy("ts").json(f"{top}/files/{name}")
        rows = connector.landed(s, "bars", f"{top}/files", stream=True)
        rows = rows.where("ticker is not null").select("ts", F.col("ticker").alias("stock"), "close")
        ingest.upsert_stream(rows, f"{top}/table", f"{top}/log").awaitTermination()
    return r6(snapshot.read(s, f"{top}/table", schema))


def landed_statements(s, d):
    """Statements of order lines, filed on the first of a month, each for two tickers."""
    path, line = _top(s, "landed"), F.col("l_linenumber")
    f = fixture.table(s, d, "lineitem").select(
        F.date_trunc("month", "l_shipdate").cast("date").alias("ts"),
        F.array(F.col("l_suppkey").cast("string"), (F.col("l_suppkey") + 1).cast("string")).alias("tickers"),
        F.when(line < 7, "annual").otherwise("quarterly").alias("timeframe"),
        # some lines are there twice with other amounts
        (((F.col("l_orderkey") * 8 + line) * 100 + F.col("l_quantity").cast("long")) * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("seq"),
        F.when(line % 3 > 0, F.col("l_quantity")).alias("net_income"),
        F.when(line % 2 == 0, F.col("l_extendedprice")).alias("ebitda"),
    )
    f.repartition(8, "ts").write.partitionBy("ts").json(f"{path}/1")
    return r6(connector.latest_statements(connector.landed(s, "statements", path)).select("ts", "stock", "net_income", "ebitda"))


def wide_csv(s, d):
    """The panel as a file with a column for each attribute and stock, written and read back."""
    path = f"{_top(s, 'wide')}/panel.csv"
    files.write_wide_csv(raw(s, d).select("ts", "stock", "close", "volume", "total_liabilities"), path)
    return r6(files.read_panel(s, path).withColumn("stock", F.col("stock").cast("long")))


def written_panel(s, d):
    """Two years of a panel that was written in folders by year."""
    path = f"{_top(s, 'panel')}/panel.parquet"
    files.write_panel(bars(s, d).select("ts", "stock", "close"), path)
    return r6(files.read_panel(s, path, ["close", "year"]).where("year between 1994 and 1995").drop("year"))


def read_or_empty(s, d):
    """A table that isn't there beside one that is."""
    path = _top(s, "some")
    bars(s, d).select("ts", "stock", "close").write.parquet(path)
    schema = "ts date, stock long, close double"
    return r6(files.read_or_empty(s, path, schema).union(files.read_or_empty(s, f"{path}-none", schema)))


def column_order(s, d):
    return r6(panel.ordered(bars(s, d).select("vwap", "close", "ts", "volume", "stock", "open")))


_COLUMNS: dict[str, Query] = {
    "daily_return": column(raw, lambda: ts.daily_return()),
    "bfill": column(raw, lambda: ts.bfill("close")),
    "ts_delay": column(raw, lambda: ts.ts_delay("close", 3)),
    "ts_delta": column(raw, lambda: ts.ts_delta("close", 5)),
    "ts_mean": column(filled, lambda: ts.ts_mean("close", 20)),
    "ts_sum": column(raw, lambda: ts.ts_sum("close", 5)),
    "ts_std": column(filled, lambda: ts.ts_std("close", 20)),
    "ts_zscore": column(filled, lambda: ts.ts_zscore("close", 60)),
    "ts_rank": column(filled, lambda: ts.ts_rank("close", 60)),
    "ts_ewm_sum": column(filled, lambda: ts.ts_ewm_sum("close", 20, 5.0)),
    "decay": column(raw, lambda: ts.decay("close", 4)),
    "forward_return": column(filled, lambda: ts.forward_return("close", 5)),
    "backward_label": column(filled, lambda: ts.daily_return("close", -1)),
    "log_return": column(raw, lambda: ts.log_return()),
    "xs_rank": column(raw, lambda: xs.rank("close", 9)),
    "xs_zscore": column(raw, lambda: xs.zscore("close")),
    "neutralize_market": column(raw, lambda: xs.neutralize("close")),
    "neutralize_industry": column(raw, lambda: xs.neutralize("close", sc.sic_division("sic_code"))),
    "neutralize_sub_industry": column(raw, lambda: xs.neutralize("close", "sic_code")),
    "winsorize": column(raw, lambda: xs.winsorize("close")),
    "if_else": column(raw, lambda: sc.if_else(F.col("close") > F.col("vwap"), F.col("high"), F.col("low"))),
    "ones": column(raw, lambda: sc.ones()),
    "zeros": column(raw, lambda: sc.zeros()),
    "cap": column(raw, lambda: sc.cap() / 1e6),
    "enterprise_value": column(raw, lambda: sc.enterprise_value() / 1e6),
}

_PLAIN = """scan_panel densify calendar_reindex unpivot_long pivot_wide split_dates slice_stock drop_all_null_dates incomplete_dates
upsert_latest_date union_by_name anti_join_new_dates stride_dates explode_tickers_last nan_handling semi_join_common_stock top_n_ticker top_n_cik
clean_data asof_rf asof_benchmark sic_division industry_ranges ffill_limit first_usable_date settings_default settings_decay1 safe_settings_no_sic
estimated_market_cap rsi rsi_strict common_stocks attribute_set factor_engine all_factors long_windows user_factor factor_cache_grows ic_1d rank_ic icir_summary icir_intervals coverage_filter impute_medians ols_1factor results_by_horizon predict_returns kfold_tune
walk_forward_splits walk_forward_tune ewma_weights factor_returns_pinv factor_residuals factor_covariance specific_variance industry_exposures covariance_matrix covariance_matrix_as_of optimize_weights
optimize_equal_weight_fallback held_weights weights_by_horizon hold_weights prepare_weights weight_totals unscaled_weights slippage_tiers gross_return turnover equity_drawdown metrics_ungated benchmark_metrics
report_metrics plot_series weight_summary backtest_gated_costs event_bars stream_upsert snapshot_as_of stream_out_of_order landed_bars landed_bars_stream landed_statements
wide_csv written_panel read_or_empty column_order""".split()


def _factor(name: str) -> Query:
    return lambda s, d: r6(evaluated(filled(s, d), [name], SCALES).withColumnRenamed(name, "z"))


def factor_query(name: str) -> str:
    """The name tells the scale where there is one."""
    return f"factor_{name}_w{SCALES[name]}" if name in SCALES else f"factor_{name}"


def queries() -> dict[str, Query]:
    found = {n: globals()[n] for n in _PLAIN} | _COLUMNS
    found |= {factor_query(n): _factor(n) for n in FACTORS}
    found |= {f"{k}_per_date": _per_date(k, a) for k, a in (("ols", 0.0), ("ridge", 1.0), ("lasso", 1e-4), ("elastic_net", 1e-4))}
    return found
