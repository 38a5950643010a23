"""Named factors, and the plan that evaluates many of them together.

A factor is an expression (functions/expr.py); its settings (winsorise,
neutralise, decay, standardise) go on around it. The windows of all factors
asked for are made side by side: however many there are, the panel is dealt out
by stock, by date, by stock and by date, four exchanges (and one for ranks in
time, if any factor has them).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import expr as e
from quantloom.functions import scalar as sc
from quantloom.functions.expr import Expr, c
from quantloom.operators.evaluate import covered
from quantloom.operators.panel import numbered_dates, require, split_dates
from quantloom.sources.files import cache_key
from quantloom.streaming import snapshot


@dataclass(frozen=True)
class Settings:
    """How a factor's values are finished; None leaves a step out."""

    winsorize: tuple[float, float] | None = (0.01, 0.99)
    neutralize: str | None = "market"
    decay: int | None = 4

    def __post_init__(self):
        if self.neutralize not in (None, "market", "industry", "sub_industry"):
            raise ValueError(f"unknown neutralisation {self.neutralize!r}")


LIBRARY = Settings(neutralize="sub_industry")


@dataclass(frozen=True)
class Factor:
    """An expression by window scale, and its settings."""

    value: Callable[[int], Expr]
    settings: Settings = LIBRARY


FACTORS: dict[str, Factor] = {}


def factor(make: Callable[[int], Expr] | None = None, **settings) -> Callable:
    """Registers a function of the window scale that gives an expression; the factor
    has its name. Settings that differ from the library's may be given."""
    if make is None:
        return lambda f: factor(f, **settings)
    FACTORS[make.__name__] = Factor(make, replace(LIBRARY, **settings))
    return make


def days(n: int, scale: int) -> int:
    """A window of n days in rows of `scale` days each."""
    return max(1, n // scale)


def settled(x: Expr, s: Settings, classified: bool = True) -> Expr:
    """x winsorised, neutralised, decayed and standardised. Without classified stocks all neutralisation is by market."""
    x = e.winsor(x, *s.winsorize) if s.winsorize else x
    if s.neutralize:
        group = {"industry": e.cell("division", sc.sic_division, "sic_code"), "sub_industry": e.c("sic_code")}.get(s.neutralize) if classified else None
        x = e.neutral(x, group)
    return e.standard(e.decay(x, s.decay) if s.decay else x)


def finished(df: DataFrame, of: dict[str, Settings]) -> DataFrame:
    """ts, stock and the columns named, after their settings."""
    return e.computed(df, {k: settled(e.c(k), s, "sic_code" in df.columns) for k, s in of.items()})


def expressions(names: list[str] | None = None, scale: int | dict[str, int] = 1, classified: bool = True) -> dict[str, Expr]:
    """Factors (all, if none are named) with their settings. scale: panel days a row, for all or by name (1 for others)."""
    by_name = scale if isinstance(scale, dict) else dict.fromkeys(FACTORS, scale)
    names = list(FACTORS) if names is None else names
    if unknown := [n for n in names if n not in FACTORS]:
        raise ValueError(f"no such factor: {', '.join(unknown)}")
    clean = lambda x: e.cell("clean", sc.clean, x)
    return {n: settled(clean(FACTORS[n].value(by_name.get(n, 1))), FACTORS[n].settings, classified) for n in names}


def evaluated(panel: DataFrame, names: list[str] | None = None, scale: int | dict[str, int] = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """ts, stock, the columns `keep`, and a column for each factor; see expressions(). panel: dense."""
    df = require(panel, "ts", "stock", "close", *keep)
    return e.computed(df, expressions(names, scale, "sic_code" in df.columns), keep)


def grown(panel: DataFrame, folder: str, source: str, names: list[str], scale: int | dict[str, int] = 1) -> DataFrame:
    """ts, stock and factors of all dates of panel (dense), from a table in folder that
    grows: dates after its last are computed, from a panel that goes back as far
    as the factors reach, and put beside the others, which aren't written again.

    source names the panel's data; another source, other factors or other scales
    are another table. Dates that are there are taken as they are, so a panel
    whose past has changed needs another name.
    """
    spark = panel.sparkSession
    made = expressions(names, scale, "sic_code" in panel.columns)
    table = f"{folder}/factors-{cache_key(source, names, scale=scale)}"
    schema = ", ".join(["ts date", f"stock {dict(panel.dtypes)['stock']}", *(f"`{n}` double" for n in names)])
    last = snapshot.read(spark, table, schema).agg(F.max("ts")).first()[0]
    dates = numbered_dates(panel)
    new = dates if last is None else dates.where(F.col("ts") > F.lit(last))
    start = new.agg(F.min("rn").alias("rn")).first().rn
    if start is not None:
        reach = max(x.reach for x in made.values())
        first = dates.where(F.col("rn") == max(0, start - reach)).first().ts
        rows = e.computed(panel.where(F.col("ts") >= F.lit(first)), made)
        snapshot.upsert(rows if last is None else rows.where(F.col("ts") > F.lit(last)), table)
    return snapshot.read(spark, table, schema)


def modelled(panel: DataFrame, names: list[str], scale: int | dict[str, int] = 1, least: float = 0.5) -> DataFrame:
    """ts, stock, split, and the factors that have values in at least that share of the training cells."""
    df = split_dates(evaluated(panel, names, scale))
    return df.select("ts", "stock", "split", *covered(df.where("split = 'train'"), names, least))


def ret() -> Expr:
    return e.returns("close")


def log_return() -> Expr:
    return e.ln("close") - e.delay(e.ln("close"), 1)


def cap() -> Expr:
    return c("close") * c("diluted_shares_outstanding")


def value_of_firm() -> Expr:
    return cap() + c("total_liabilities") - c("cash_and_equivalents")


def still() -> Expr:
    return e.indicator(ret().equals(0.0))


@factor
def mean_reversion_0(scale: int) -> Expr:
    return -e.rank(e.zscore(ret(), days(252, scale)))


@factor
def mean_reversion_1(scale: int) -> Expr:
    apart = (c("close") - c("vwap")) / e.mean("vwap", days(20, scale))
    return -e.standard(apart) * e.rank(e.delta("volume", days(5, scale))) * e.rank(cap())


@factor
def mean_reversion_2(scale: int) -> Expr:
    low = -(c("close") / e.mean("close", days(20, scale)))
    cheap = c("diluted_earnings_per_share") / c("close")
    return e.rank(e.zscore(low, days(5, scale))) + e.rank(e.rank_in_time(cheap, days(60, scale)))


@factor
def mean_reversion_3(scale: int) -> Expr:
    night, day = e.ln(c("open") / e.delay("close", 1)), e.ln(c("close") / c("open"))
    return e.rank(e.mean(night, days(20, scale))) - e.rank(e.mean(day, days(20, scale)))


@factor(decay=1)
def mean_reversion_4(scale: int) -> Expr:
    wide = e.zscore(c("high") / c("low") - 1, days(60, scale)) > 1.0
    return -e.sum_(e.indicator(wide) * ret(), days(60, scale))


@factor(decay=1)
def mean_reversion_5(scale: int) -> Expr:
    w = days(5, scale)
    return -((e.rank(e.delta("close", w) / e.mean(c("high") - c("low"), w)) - 0.5) ** 3)


@factor
def fundamental_1(scale: int) -> Expr:
    multiple = e.some(value_of_firm() / c("ebitda"))
    return -e.standard(e.mean(multiple, days(252, scale)) / multiple)


@factor(decay=12)
def fundamental_2(scale: int) -> Expr:
    year, earned = days(252, scale), c("operating_income") / cap()
    falls = e.sum_(e.indicator(ret() < 0.0), year)
    return e.rank(e.delta(earned, days(125, scale)) / e.std(earned, year)) + e.rank(falls) + e.rank(-e.delta("close", 1))


@factor
def liquidity_1(scale: int) -> Expr:
    return -(e.abs_(ret()) / (c("volume") * c("close")))


@factor
def liquidity_2(scale: int) -> Expr:
    return -e.sum_(still(), days(252, scale))


@factor
def liquidity_test(scale: int) -> Expr:
    return -e.sum_(still(), days(60, scale))


@factor
def liquidity_3(scale: int) -> Expr:
    level = e.or_zero(c("close") / e.mean("close", days(60, scale)))
    return e.rank(e.sum_(still(), days(60, scale))) * (e.rank(e.mean("vwap", days(10, scale)) - c("close")) - 0.5) * e.rank(level)


@factor
def momentum_barra(scale: int) -> Expr:
    return e.delay(e.ewm(log_return(), days(504, scale), 126 / scale), days(21, scale))


@factor(decay=1)
def short_term_reversal_barra(scale: int) -> Expr:
    return -e.ewm(log_return(), days(21, scale), 5 / scale)


@factor
def liquidity_barra(scale: int) -> Expr:
    turn = c("volume") / e.mean("volume", days(252, scale))
    log = lambda w, parts: e.ln(e.some(e.sum_(turn, days(w, scale), None) / parts))
    return 0.35 * e.standard(log(21, 1)) + 0.35 * e.standard(log(63, 3)) + 0.30 * e.standard(log(252, 12))


@factor
def value_barra(scale: int) -> Expr:
    return -e.ln(c("close") / e.mean("close", days(1260, scale)))


@factor
def quality_barra(scale: int) -> Expr:
    return -e.std(ret(), days(252, scale))
