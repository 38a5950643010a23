"""SQL for the panel queries, written apart from the operators."""

from __future__ import annotations

P1 = """px as (
  select cast(date_trunc('week', l_shipdate) as date) ts, l_suppkey stock, l_extendedprice / l_quantity p, l_quantity q, l_extendedprice e,
         row_number() over (partition by date_trunc('week', l_shipdate), l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) rn,
         count(*) over (partition by date_trunc('week', l_shipdate), l_suppkey) n
  from lineitem),
bars as (
  select ts, stock, max(case when rn = 1 then p end) "open", max(p) high, min(p) low, max(case when rn = n then p end) "close", sum(q) volume, sum(e) / sum(q) vwap
  from px group by ts, stock),
grid as (select d.ts, s.stock from (select distinct ts from bars) d cross join (select distinct stock from bars) s),
fy as (select cast(year(l_shipdate) as int) yr, l_suppkey stock, sum(l_extendedprice * (1 - l_discount)) operating_income from lineitem group by 1, 2),
p1 as (
  select g.ts, g.stock, b."open", b.high, b.low, b."close", b.volume, b.vwap,
         cast(1000 + (g.stock * 7919) % 5000 as double) diluted_shares_outstanding,
         f.operating_income, f.operating_income * 8e-1 ebitda, f.operating_income / 1e4 diluted_earnings_per_share,
         abs(s.s_acctbal) * 100 total_liabilities, abs(s.s_acctbal) * 10 cash_and_equivalents,
         case g.stock % 12 when 0 then 850 when 1 then 1040 when 2 then 1311 when 3 then 1521 when 4 then 2834
              when 5 then 3674 when 6 then 4911 when 7 then 5311 when 8 then 6020 when 9 then 7372 when 10 then 1800 end sic_code,
         case when g.stock % 17 = 0 then null else cast(floor(g.stock / 2) as bigint) end cik,
         case when g.stock % 5 = 0 then 'ETF' else 'CS' end sec_type
  from grid g left join bars b on g.ts = b.ts and g.stock = b.stock
  left join fy f on f.yr = year(g.ts) and f.stock = g.stock
  left join supplier s on s.s_suppkey = g.stock)"""
FILL = "last_value({0} ignore nulls) over (partition by stock order by ts rows between unbounded preceding and current row) {0}"
PRICES = ('"open"', "high", "low", '"close"', "volume", "vwap")
P1F = P1 + ",\npf as (select * exclude (" + ", ".join(PRICES) + "), " + ", ".join(FILL.format(c) for c in PRICES) + " from p1)"
BENCH = "bench as (select cast(date_trunc('week', o_orderdate) as date) ts, avg(o_totalprice) close from orders group by 1)"
RF = "rfs as (select cast(date_trunc('quarter', l_shipdate) as date) ts, avg(l_tax) rf from lineitem group by 1)"
DATES = "dts as (select ts, row_number() over (order by ts) - 1 rn, count(*) over () n from (select distinct ts from p1))"
TIES = 9
UP = "1.00000000001e0"


def r6(x: str, name: str | None = None) -> str:
    """To six places; exact halves go up in either engine, for they are drawn up first."""
    return f"round(({x}) * {UP}, 6) + 0.0 {x if name is None else name}"


def over(w: int | None = None) -> str:
    frame = "" if w is None else f" rows between {w - 1} preceding and current row"
    return f"over (partition by stock order by ts{frame})"


def lag(x: str, n: int = 1) -> str:
    return f"{'lag' if n > 0 else 'lead'}({x}, {abs(n)}) {over()}"


def full(x: str, w: int, agg: str) -> str:
    return f"case when count({x}) {over(w)} = {w} then {agg} {over(w)} end"


def mean(x: str, w: int) -> str:
    return full(x, w, f"avg({x})")


def std(x: str, w: int) -> str:
    return full(x, w, f"stddev_samp({x})")


def total(x: str, w: int) -> str:
    return full(x, w, f"sum({x})")


def ret(p: str = "close", n: int = 1) -> str:
    return f"{p} / nullif({lag(p, n)}, 0) - 1"


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def tz(x: str, w: int) -> str:
    return f"({x} - ({mean(x, w)})) / (case when ({std(x, w)}) > 1e-12 then ({std(x, w)}) end)"


def ewm(x: str, w: int, hl: float) -> str:
    """Needs {x}_l, the window's list."""
    raw = [0.5 ** ((w - 1 - i) / hl) for i in range(w)]
    return f"case when count({x}) {over(w)} = {w} then list_sum(list_transform(list_zip({x}_l, {[v / sum(raw) for v in raw]!r}::double[]), lambda z: z[1] * z[2])) end"


def listed(x: str, w: int) -> str:
    return f"list({x}) {over(w)}"


def linear(x: str, n: int) -> str:
    if n < 2:
        return x
    terms = [f"{2 * (n - i) / (n * (n + 1))!r}::double * {lag(x, n - 1 - i) if i < n - 1 else x}" for i in range(n)]
    return " + ".join(terms)


def xrank(x: str) -> str:
    x = f"round({x}, {TIES})"
    return f"case when {x} is not null then (rank() over (partition by ts order by {x} nulls last) + (count({x}) over (partition by ts, {x}) - 1) / 2.0) / count({x}) over (partition by ts) end"


def xz(x: str) -> str:
    return f"({x} - avg({x}) over (partition by ts)) / (case when stddev_samp({x}) over (partition by ts) > 1e-12 then stddev_samp({x}) over (partition by ts) end)"


def layers(base: str, steps: list[dict[str, str]], out: str, source: str = P1F) -> str:
    """A query of steps that each add columns to the one before."""
    parts, last = [source], base
    for i, s in enumerate(steps):
        parts.append(f"t{i} as (select *, " + ", ".join(f"{v} as {k}" for k, v in s.items()) + f" from {last})")
        last = f"t{i}"
    return "with " + ",\n".join(parts) + f"\nselect {out} from {last}"


def settings(x: str, neutral: str | None = "sub_industry", n: int = 4, winsor: bool = True) -> list[dict[str, str]]:
    """Steps from column x to column z."""
    by = {"market": None, "industry": "division", "sub_industry": "sic_code"}
    first = f"case when {x} is not null then least(greatest({x}, quantile_cont({x}, 0.01) over (partition by ts)), quantile_cont({x}, 0.99) over (partition by ts)) end" if winsor else x
    if neutral is None:
        second = "w_"
    elif by[neutral] is None:
        second = "w_ - avg(w_) over (partition by ts)"
    else:
        g = by[neutral]
        second = f"case when {g} is not null then w_ - avg(w_) over (partition by ts, {g}) else w_ end"
    return [{"w_": first}, {"n_": second}, {"d_": linear("n_", n)}, {"z": xz("d_")}]


DIVISION = "case when floor(sic_code / 100) between 1 and 9 then 'A' when floor(sic_code / 100) between 10 and 14 then 'B' when floor(sic_code / 100) between 15 and 17 then 'C' when floor(sic_code / 100) between 20 and 39 then 'D' when floor(sic_code / 100) between 40 and 49 then 'E' when floor(sic_code / 100) between 50 and 51 then 'F' when floor(sic_code / 100) between 52 and 59 then 'G' when floor(sic_code / 100) between 60 and 67 then 'H' when floor(sic_code / 100) between 70 and 89 then 'I' when floor(sic_code / 100) between 91 and 99 then 'J' end"

R = {"r_": ret()}
C = {"cap_": "close * diluted_shares_outstanding"}
STILL = {"s_": "coalesce(cast(r_ = 0 as double), 0)"}


def factor_steps(d) -> dict[str, tuple[list[dict[str, str]], str | None, int]]:
    """Steps that end in column x, neutralisation and decay by factor. d: rows for days."""
    w = d(252)
    turn = [{"u_": ratio("volume", mean("volume", w))}, {"a_": f"ln(nullif({total('u_', d(21))}, 0))", "b_": f"ln(nullif(({total('u_', d(63))}) / 3, 0))", "c_": f"ln(nullif(({total('u_', w)}) / 12, 0))"}]
    sub = "sub_industry"
    return {
        "mean_reversion_0": ([R, {"a_": tz("r_", w)}, {"x": f"-({xrank('a_')})"}], sub, 4),
        "mean_reversion_1": ([C | {"a_": ratio("close - vwap", mean("vwap", d(20))), "b_": f"volume - {lag('volume', d(5))}"}, {"x": f"-({xz('a_')}) * ({xrank('b_')}) * ({xrank('cap_')})"}], sub, 4),
        "mean_reversion_2": (
            [{"a_": f"-({ratio('close', mean('close', d(20)))})", "e_": ratio("diluted_earnings_per_share", "close")}, {"e_l": listed("e_", d(60)), "n60": f"count(e_) {over(d(60))}", "b_": tz("a_", d(5))}, {"c_": f"case when n60 = {d(60)} then len(list_filter(e_l, lambda v: v < e_)) / {d(60) - 1}.0 end"}, {"x": f"({xrank('b_')}) + ({xrank('c_')})"}],
            sub,
            4,
        ),
        "mean_reversion_3": ([{"a_": f"ln({ratio('open', lag('close'))})", "b_": f"ln({ratio('close', 'open')})"}, {"c_": mean("a_", d(20)), "e_": mean("b_", d(20))}, {"x": f"({xrank('c_')}) - ({xrank('e_')})"}], sub, 4),
        "mean_reversion_4": ([R | {"a_": f"{ratio('high', 'low')} - 1"}, {"b_": tz("a_", d(60))}, {"c_": "coalesce(cast(b_ > 1 as double), 0) * r_"}, {"x": f"-coalesce({total('c_', d(60))}, 0)"}], sub, 1),
        "mean_reversion_5": ([{"a_": "high - low"}, {"b_": ratio(f"close - {lag('close', d(5))}", mean("a_", d(5)))}, {"x": f"-pow(({xrank('b_')}) - 0.5, 3)"}], sub, 1),
        "fundamental_1": ([C, {"m_": "nullif((cap_ + total_liabilities - cash_and_equivalents) / nullif(ebitda, 0), 0)"}, {"a_": ratio(mean("m_", w), "m_")}, {"x": f"-({xz('a_')})"}], sub, 4),
        "fundamental_2": (
            [R | C | {"f_": f"-(close - {lag('close')})"}, {"o_": ratio("operating_income", "cap_"), "l_": "coalesce(cast(r_ < 0 as double), 0)"}, {"a_": ratio(f"o_ - {lag('o_', d(125))}", std("o_", w)), "b_": f"coalesce({total('l_', w)}, 0)"}, {"x": f"({xrank('a_')}) + ({xrank('b_')}) + ({xrank('f_')})"}],
            sub,
            12,
        ),
        "liquidity_1": ([R, {"x": f"-({ratio('abs(r_)', 'volume * close')})"}], sub, 4),
        "liquidity_2": ([R, STILL, {"x": f"-coalesce({total('s_', w)}, 0)"}], sub, 4),
        "liquidity_test": ([R, STILL, {"x": f"-coalesce({total('s_', d(60))}, 0)"}], sub, 4),
        "liquidity_3": ([R, STILL, {"a_": f"coalesce({total('s_', d(60))}, 0)", "b_": f"({mean('vwap', d(10))}) - close", "c_": f"coalesce({ratio('close', mean('close', d(60)))}, 0)"}, {"x": f"({xrank('a_')}) * (({xrank('b_')}) - 0.5) * ({xrank('c_')})"}], sub, 4),
        "momentum_barra": ([{"g_": f"ln(close) - ln({lag('close')})"}, {"g__l": listed("g_", d(504))}, {"m_": ewm("g_", d(504), d(126 * 5) / 5)}, {"x": lag("m_", d(21))}], sub, 4),
        "short_term_reversal_barra": ([{"g_": f"ln(close) - ln({lag('close')})"}, {"g__l": listed("g_", d(21))}, {"m_": ewm("g_", d(21), 5.0)}, {"x": "-m_"}], sub, 1),
        "liquidity_barra": ([*turn, {"x": f"0.35 * ({xz('a_')}) + 0.35 * ({xz('b_')}) + 0.30 * ({xz('c_')})"}], sub, 4),
        "value_barra": ([{"a_": ratio("close", mean("close", d(1260)))}, {"x": "-ln(a_)"}], sub, 4),
        "quality_barra": ([R, {"x": f"-({std('r_', w)})"}], sub, 4),
    }


#: Factors whose windows are counted in rows of five days.
SCALED = ("momentum_barra", "value_barra")
INDUSTRIES = """Agric Food Soda Beer Smoke Toys Fun Books Hshld Clths Hlth MedEq Drugs Chems Rubbr Txtls BldMt Cnstr Steel FabPr Mach ElcEq Autos Aero Ships
Guns Gold Mines Coal Oil Util Telcm PerSv BusSv Hardw Softw Chips LabEq Paper Boxes Trans Whlsl Rtail Meals Banks Insur RlEst Fin Other""".split()
INDUSTRY = "case when sic_code between 100 and 999 then 'Agric' when sic_code between 2833 and 2836 then 'Drugs' when sic_code between 1520 and 1529 then 'Cnstr' when sic_code between 1040 and 1049 then 'Gold' when sic_code between 1310 and 1319 then 'Oil' when sic_code between 4910 and 4911 then 'Util' when sic_code between 7370 and 7372 then 'BusSv' when sic_code between 3670 and 3679 then 'Chips' when sic_code between 5310 and 5311 then 'Rtail' when sic_code = 6020 then 'Banks' else 'Other' end"


def fits(kind: str, alpha: float, l1: float = 1.0) -> str:
    """CTEs from cv (ts, n, m1, m2, my, a, b, c, p, q, v: means and covariances over n) to ft (ts, w1, w2, ...)."""
    if kind in ("ols", "ridge"):
        k = 0.0 if kind == "ols" else alpha
        return f"ft as (select *, ((c + {k} / n) * p - b * q) / ((a + {k} / n) * (c + {k} / n) - b * b) w1, ((a + {k} / n) * q - b * p) / ((a + {k} / n) * (c + {k} / n) - b * b) w2 from cv)"
    soft = f"sign({{0}}) * greatest(abs({{0}}) - {alpha * l1!r}::double, 0) / nullif({{1}} + {alpha * (1 - l1)!r}::double, 0)"
    first = soft.format("(p - b * w2)", "a")
    return f"""step as (
  select ts, 0 k, 0.0::double w1, 0.0::double w2 from cv
  union all
  select ts, k + 1, w1n, {soft.format("(q - b * w1n)", "c")} from (select step.ts, k, w2, a, b, c, p, q, {first} w1n from step join cv using (ts) where k < 2000)),
ft as (select cv.*, w1, w2 from cv join step using (ts) where k = 2000)"""


def moments(x: str) -> str:
    """Sums of products of (1, s1, s2, fwd) of rows x, as columns."""
    return f"count(*) n, sum(s1) t1, sum(s2) t2, sum(fwd) ty, sum(s1 * s1) t11, sum(s1 * s2) t12, sum(s2 * s2) t22, sum(s1 * fwd) t1y, sum(s2 * fwd) t2y, sum(fwd * fwd) tyy from {x}"


SUMS = ("n", "t1", "t2", "ty", "t11", "t12", "t22", "t1y", "t2y", "tyy")


def ridged(a: str) -> tuple[str, str, str]:
    """(w1, w2, c) of a ridge fit to the sums of alias a; alpha is a column."""
    g11, g12, g22 = f"({a}.t11 - {a}.t1 * {a}.t1 / {a}.n + alpha)", f"({a}.t12 - {a}.t1 * {a}.t2 / {a}.n)", f"({a}.t22 - {a}.t2 * {a}.t2 / {a}.n + alpha)"
    b1, b2 = f"({a}.t1y - {a}.t1 * {a}.ty / {a}.n)", f"({a}.t2y - {a}.t2 * {a}.ty / {a}.n)"
    det = f"({g11} * {g22} - {g12} * {g12})"
    w1, w2 = f"(({g22} * {b1} - {g12} * {b2}) / {det})", f"(({g11} * {b2} - {g12} * {b1}) / {det})"
    return w1, w2, f"({a}.ty / {a}.n - {w1} * {a}.t1 / {a}.n - {w2} * {a}.t2 / {a}.n)"


def missed(a: str) -> str:
    """Mean squared error of w1, w2, c on the rows whose sums alias a has."""
    return f"({a}.tyy - 2 * c * {a}.ty - 2 * w1 * {a}.t1y - 2 * w2 * {a}.t2y + {a}.n * c * c + 2 * c * w1 * {a}.t1 + 2 * c * w2 * {a}.t2 + w1 * w1 * {a}.t11 + 2 * w1 * w2 * {a}.t12 + w2 * w2 * {a}.t22) / {a}.n"


STYLES = f"""{P1F},
y1 as (select *, {lag('close', -1)} / nullif(close, 0) - 1 fwd, {mean('close', 20)} m20, {ret()} r_ from pf),
y2 as (select *, close / nullif(m20, 0) - 1 dev, {std('r_', 20)} vol from y1),
st as (select ts, stock, close, fwd, r_ r, {INDUSTRY} industry, {xz('dev')} s1, {xz('vol')} s2 from y2)"""
#: Regressions on styles and an industry each: industries are taken out by their means, then two styles are left.
RISK = f"""{STYLES},
rs as (select ts, stock, industry g, coalesce(r, 0) r, coalesce(s1, 0) s1, coalesce(s2, 0) s2 from st where ts in (select ts from st where r is not null)),
gm as (select *, avg(s1) over (partition by ts, g) g1, avg(s2) over (partition by ts, g) g2, avg(r) over (partition by ts, g) gr from rs),
sm as (select ts, sum((s1 - g1) * (s1 - g1)) a, sum((s1 - g1) * (s2 - g2)) b, sum((s2 - g2) * (s2 - g2)) c, sum((s1 - g1) * (r - gr)) p, sum((s2 - g2) * (r - gr)) q from gm group by ts),
sw as (select ts, case when a > 1e-9 and c > 1e-9 then (c * p - b * q) / (a * c - b * b) when a > 1e-9 then p / a else 0 end w1, case when a > 1e-9 and c > 1e-9 then (a * q - b * p) / (a * c - b * b) when c > 1e-9 then q / c else 0 end w2 from sm),
fr as (select ts, 0 k, w1 f from sw union all select ts, 1, w2 from sw union all select distinct ts, list_position({INDUSTRIES!r}, g)::int + 1, gr - w1 * g1 - w2 * g2 from gm join sw using (ts)),
er as (select ts, stock, r - gr - w1 * (s1 - g1) - w2 * (s2 - g2) e, r from gm join sw using (ts))"""


def eliminated(m: str, size: str, ok: str) -> str:
    """The symmetric matrix m (lists of rows) after Gauss's elimination: pivots on its diagonal,
    and beside each what was left of its row and column. Pivots for which `ok` doesn't hold are left out."""
    at = "e[1][1]::int"
    step = f"list_transform(range(1, {size} + 1), lambda i: list_transform(range(1, {size} + 1), lambda j: case when i > {at} and j > {at} and {ok.format(f'acc[{at}][{at}]', at)} then acc[i][j] - acc[i][{at}] * acc[{at}][j] / acc[{at}][{at}] else acc[i][j] end))"
    return f"list_reduce(list_prepend({m}, list_transform(range(1, {size} + 1), lambda p: [[p::double]])), lambda acc, e: {step})"


def product(a: str, b: str, size: str, turned: bool = False) -> str:
    """a b, or a' b if turned, of square matrices."""
    return f"list_transform(range(1, {size} + 1), lambda i: list_transform(range(1, {size} + 1), lambda j: list_sum(list_transform(range(1, {size} + 1), lambda k: {a}[{'k][i' if turned else 'i][k'}] * {b}[k][j]))))"


#: CTEs from cc, ex and sv (see covariance_matrix) to jd (bad): whether the largest eigenvalue of V = X F X' + D is more than
#: 1e4 times the least, or that is 1e-12 or less. It is so if for some t an eigenvalue lies below t and one above 1e4 t; t is
#: halved in. Eigenvalues below t are counted without V: as many as D has, less the negative pivots of 1 + L' X' (D - t)^-1 X L, F = L L'.
JUDGED = f"""kz as (select k, row_number() over (order by k) p, count(*) over () m from (select distinct i k from cc)),
fz as (select m, list(r order by p) f from (select x.p, x.m, list(cov order by y.p) r from cc join kz x on x.k = i join kz y on y.k = j group by 1, 2) group by m),
lz as (select m, list_transform(range(1, m + 1), lambda i: list_transform(range(1, m + 1), lambda j: case when i >= j and g[j][j] > 1e-14 * f[j][j] then g[i][j] / sqrt(g[j][j]) else 0.0 end)) l from (select *, {eliminated("f", "m", "{0} > 1e-14 * f[{1}][{1}]")} g from fz)),
pz as (select x.p i, y.p j, a.v * b.v v, sv.v d from ex a join ex b using (stock) join sv using (stock) join kz x on x.k = a.k join kz y on y.k = b.k
  union all select x.p, y.p, 0, -1 from kz x, kz y union all select 0, 0, 0, v from sv),
nz as (select count(*) n, min(d + o) own from (select a.stock, any_value(sv.v) d, sum(a.v * cov * b.v) o from ex a join cc on cc.i = a.k join ex b on b.stock = a.stock and b.k = cc.j join sv on sv.stock = a.stock group by 1)),
hz as (
  select 0 step, 1e-12::double lo, greatest(own, 1e-12::double) hi, null::boolean bad from nz
  union all
  select step + 1, case when a = 0 and step > 0 then t else lo end, case when a > 0 and step > 0 then t else hi end,
         case when a > 0 and (b < n or step = 0) then true when a = 0 and b = n then false when step = 100 then true end
  from (
    select step, lo, hi, t, n, max(case when w = 1 then c end) a, max(case when w = 2 then c end) b from (
      select *, below - len(list_filter(range(1, m + 1), lambda p: z[p][p] < 0)) c from (
        select *, {eliminated("y", "m", "{0} <> 0")} z from (
          select * exclude (y), list_transform(range(1, m + 1), lambda i: list_transform(range(1, m + 1), lambda j: (i = j)::int + y[i][j])) y from (
            select *, {product("l", "sl", "m", True)} y from (
              select *, {product("s", "l", "m")} sl from (
                select step, lo, hi, t, w, max(below) below, list_transform(range(1, any_value(m) + 1), lambda i: list(v order by i_, j_) filter (i_ > 0)[(i - 1) * any_value(m) + 1:i * any_value(m)]) s, any_value(m) m, any_value(l) l from (
                  select step, lo, hi, t, w, i i_, j j_, sum(v / case when d = t * w_ then 1e-300 else d - t * w_ end) v, count(*) filter (d < t * w_ and i = 0) below
                  from (select *, case when step = 0 then lo else sqrt(lo) * sqrt(hi) end t from hz where bad is null) q cross join (values (1, 1.0::double), (2, 1e4::double)) ww(w, w_) cross join pz group by all), lz
                group by step, lo, hi, t, w)))))), nz
    group by step, lo, hi, t, n)),
jd as (select bool_or(bad) bad from hz)"""


def aged(dates: str, hl: float) -> str:
    """ts, w of the dates of a relation: weights that halve every hl dates."""
    return f"(select ts, exp(-ln(2) / {hl} * (count(*) over () - row_number() over (order by ts))) / sum(exp(-ln(2) / {hl} * rk)) over () w from (select ts, count(*) over () - row_number() over (order by ts) rk from (select distinct ts from {dates})))"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    p, f = f"with {P1} ", f"with {P1F} "
    bars6 = ", ".join(r6(c) for c in PRICES)
    o["scan_panel"] = f"{p} select ts, stock, {bars6} from bars"
    o["densify"] = f"{p} select ts, stock, {bars6}, {r6('operating_income')}, {r6('total_liabilities')}, sic_code, cik, sec_type from p1"
    o["calendar_reindex"] = f"{p} select c.ts, s.stock, {r6('b.close', 'close')} from (select unnest(generate_series(min(ts), max(ts), interval 1 day))::date ts from bars) c cross join (select distinct stock from bars) s left join bars b on b.ts = c.ts and b.stock = s.stock"
    o["unpivot_long"] = f"{p}, u as (select ts, stock, close, volume, vwap from p1) select ts, stock, 'close' attribute, {r6('close', 'value')} from u union all select ts, stock, 'volume', {r6('volume')} from u union all select ts, stock, 'vwap', {r6('vwap')} from u"
    o["pivot_wide"] = f"{p} select ts, stock, {r6('close')}, {r6('volume')}, {r6('vwap')} from p1"
    o["split_dates"] = f"{p}, {DATES} select ts, stock, case when rn < floor(n * 0.7) then 'train' when rn < floor(n * (0.7 + 0.15)) then 'cv' else 'test' end split from p1 join dts using (ts)"
    o["slice_stock"] = f"{p} select ts, stock, {r6('close')} from p1 where stock = 7"
    o["drop_all_null_dates"] = f"{p}, u as (select ts, stock, {ret('close', 26)} fwd from p1) select ts, stock, {r6('fwd')} from u where ts in (select ts from u where fwd is not null)"
    o["incomplete_dates"] = f"{p}, u as (select ts, sum((close is null)::int + (volume is null)::int) n_null, count(*) * 2 n from p1 group by ts) select ts, n_null::bigint n_null, n::bigint n from u where n_null > 0 and n_null < n"
    o["upsert_latest_date"] = f"{p}, nw as (select ts, stock, close * 2 as close from bars where stock % 2 = 0 and ts >= (select max(ts) from bars) - interval 30 day) select ts, stock, {r6('close')} from nw union all select ts, stock, {r6('close')} from bars where ts not in (select ts from nw)"
    o["union_by_name"] = f"{p} select ts, stock, {r6('close')}, null::double volume from bars union all select ts, stock, null, {r6('volume')} from bars"
    o["anti_join_new_dates"] = f"{p}, {BENCH} select distinct ts from bars where ts not in (select ts from bench)"
    o["stride_dates"] = f"{p}, {DATES} select ts, stock, {r6('close')} from p1 join dts using (ts) where rn % 5 = 0"
    o["explode_tickers_last"] = """with f as (select cast(date_trunc('month', l_shipdate) as date) ts, unnest([l_suppkey, l_suppkey + 1]) stock, l_orderkey * 8 + l_linenumber seq, l_partkey, case when l_linenumber % 3 > 0 then l_quantity end net_income, case when l_linenumber % 2 = 0 then l_extendedprice end ebitda from lineitem),
g as (select ts, stock, max(case when net_income is not null then seq end) a, max(case when ebitda is not null then seq end) b from f group by 1, 2)
select g.ts, g.stock, (select max(net_income) from f where f.ts = g.ts and f.stock = g.stock and seq = a) net_income, (select max(ebitda) from f where f.ts = g.ts and f.stock = g.stock and seq = b) ebitda from g"""
    o["nan_handling"] = f"{p} select ts, stock, {r6('close')}, {r6('volume')} from p1 where stock in (select stock from p1 group by stock having sum((close is null)::int + (volume is null)::int) / (count(*) * 2.0) <= 0.19)"
    o["semi_join_common_stock"] = f"{p} select ts, stock, {r6('close')} from p1 where sec_type = 'CS'"
    o["top_n_ticker"] = f"{p}, u as (select *, volume is null or rank() over (partition by ts order by volume desc nulls last) <= 5 ok from p1) select ts, stock, ok in_universe, case when ok then {r6('close', '')} else -1 end as close from u"
    o["top_n_cik"] = f"{p}, g as (select ts, cik, rank() over (partition by ts order by sum(volume) desc) k from p1 where volume is not null and cik is not null group by ts, cik) select p1.ts, stock, coalesce(k <= 4, true) in_universe from p1 left join g on g.ts = p1.ts and g.cik = p1.cik"
    o["clean_data"] = f"{p}, k as (select ts, stock, close, volume from p1 where sec_type = 'CS' and stock in (select stock from p1 group by stock having sum((close is null)::int + (volume is null)::int) / (count(*) * 2.0) <= 0.5)), u as (select *, volume is null or rank() over (partition by ts order by volume desc nulls last) <= 5 ok from k) select ts, stock, ok in_universe, case when ok then {r6('close', '')} else -1 end as close, case when ok then {r6('volume', '')} else -1 end volume from u"
    for name, cte, v in (("asof_rf", RF, "rf"), ("asof_benchmark", BENCH, "close")):
        src = "rfs" if v == "rf" else "bench"
        o[name] = f"{p}, {cte} select d.ts, round(1.00000000001e0 * coalesce((select arg_max({v}, b.ts) from {src} b where b.ts <= d.ts), (select arg_min({v}, ts) from {src})), 6) + 0.0 as {v} from (select distinct ts from bars) d"
    o["sic_division"] = f"{p} select distinct stock, sic_code, {DIVISION} division from p1"
    o["industry_ranges"] = f"{p} select distinct stock, sic_code, {INDUSTRY} industry from p1"
    o["common_stocks"] = f"{p}, {DATES}, u as (select ts, stock, {ret('close', 58)} r from p1), v as (select distinct stock, case when rn < floor(n * 0.17) then 1 when rn < floor(n * (0.17 + 0.03)) then 2 else 3 end k from u join dts using (ts) where r is not null) select stock from v group by stock having count(*) = 3"
    o["attribute_set"] = f"{p} select ts, stock, null::double total_liabilities, {r6('operating_income')} from p1 union all select ts, stock, {r6('total_liabilities')}, null from p1"
    o["ffill_limit"] = f"{p} select ts, stock, round(1.00000000001e0 * last_value(close ignore nulls) over (partition by stock order by ts rows between 2 preceding and current row), 6) + 0.0 filled from p1"
    o["first_usable_date"] = f"{p} select min(ts) ts from (select ts from p1 group by ts having avg((close is not null)::int) >= 0.8)"

    def ts(name: str, expr: str, steps: list[dict[str, str]] | None = None, base: str = "p1") -> None:
        o[name] = layers(base, [*(steps or []), {"v": expr}], f"ts, stock, {r6('v')}", P1 if base == "p1" else P1F)

    ts("daily_return", ret())
    ts("ts_delay", lag("close", 3))
    ts("ts_delta", f"close - {lag('close', 5)}")
    ts("ts_mean", mean("close", 20), base="pf")
    ts("ts_sum", f"coalesce({total('close', 5)}, 0)")
    ts("ts_std", std("close", 20), base="pf")
    ts("ts_zscore", tz("close", 60), base="pf")
    ts("ts_rank", f"case when n60 = 60 then len(list_filter(l, lambda v: v < close)) / 59.0 end", [{"l": listed("close", 60), "n60": f"count(close) {over(60)}"}], "pf")
    ts("ts_ewm_sum", ewm("close", 20, 5.0), [{"close_l": listed("close", 20)}], "pf")
    ts("decay", linear("close", 4))
    ts("user_factor", f"-({xrank('a_')})", [{"r_": ret()}, {"a_": tz("r_", 252)}], "pf")
    ranks = {f"r{w}": f"case when n{w} = {w} then len(list_filter(l{w}, lambda v: v < close)) / {w - 1}.0::double end" for w in (60, 252, 504)}
    lists = {f"l{w}": listed("close", w) for w in (60, 252, 504)} | {f"n{w}": f"count(close) {over(w)}" for w in (60, 252, 504)} | {"close_l": listed("close", 252)}
    long = {"m252": mean("close", 252), "s252": std("close", 252), "w252": ewm("close", 252, 63.0)} | ranks
    o["long_windows"] = layers("pf", [lists, long], ", ".join(["ts, stock", *(r6(x) for x in long)]))
    gl = [{"d_": f"close - {lag('close')}"}, {"g_": "case when d_ is not null then greatest(d_, 0) end", "l_": "case when d_ is not null then greatest(-d_, 0) end"}, {"a_": mean("g_", 14), "b_": mean("l_", 14)}]
    ts("rsi", "case when a_ + b_ > 0 then 100 * a_ / (a_ + b_) end", gl, "pf")
    strict = [{"d_": f"close - {lag('close')}"}, {"g_": "case when d_ > 0 then d_ end", "l_": "case when d_ < 0 then -d_ end"}, {"a_": mean("g_", 14), "b_": mean("l_", 14)}]
    ts("rsi_strict", "100 * a_ / (a_ + b_)", strict, "pf")
    ts("forward_return", f"{lag('close', -5)} / nullif(close, 0) - 1", base="pf")
    ts("backward_label", ret("close", -1), base="pf")
    ts("log_return", f"ln(close) - ln({lag('close')})")
    ts("xs_rank", xrank("close"))
    ts("xs_zscore", xz("close"))
    ts("neutralize_market", "close - avg(close) over (partition by ts)")
    ts("neutralize_industry", "case when division is not null then close - avg(close) over (partition by ts, division) else close end", [{"division": DIVISION}])
    ts("neutralize_sub_industry", "case when sic_code is not null then close - avg(close) over (partition by ts, sic_code) else close end")
    ts("winsorize", "case when close is not null then least(greatest(close, quantile_cont(close, 0.01) over (partition by ts)), quantile_cont(close, 0.99) over (partition by ts)) end")
    dev = [{"x": f"-(close / nullif({mean('close', 5)}, 0) - 1)", "division": DIVISION}]
    o["settings_default"] = layers("pf", dev + settings("x", "market", 4), f"ts, stock, {r6('z')}")
    o["settings_decay1"] = layers("pf", dev + settings("x", "industry", 1), f"ts, stock, {r6('z')}")
    o["safe_settings_no_sic"] = layers("pf", dev + settings("x", "market", 4), f"ts, stock, {r6('z')}")
    ts("if_else", "case when close > vwap then high when not (close > vwap) then low end")
    o["ones"] = f"{p} select ts, stock, 1.0::double v from grid"
    o["zeros"] = f"{p} select ts, stock, 0.0::double v from grid"
    ts("cap", "close * diluted_shares_outstanding / 1e6")
    ts("enterprise_value", "(close * diluted_shares_outstanding + total_liabilities - cash_and_equivalents) / 1e6")
    o["estimated_market_cap"] = f"{f}, e as (select stock, diluted_shares_outstanding * 2 / nullif(close, 0) k from pf where ts = (select max(ts) from pf)) select pf.ts, pf.stock, round(1.00000000001e0 * close * k / 1e6, 6) + 0.0 est_cap from pf left join e on e.stock = pf.stock"
    whole, fifth = factor_steps(lambda n: n), factor_steps(lambda n: n // 5)
    steps_of = {n: fifth[n] if n in SCALED else whole[n] for n in whole}
    for name, (steps, neutral, n) in steps_of.items():
        o[f"factor_{name}" + "_w5" * (name in SCALED)] = layers("pf", steps + settings("x", neutral, n), f"ts, stock, {r6('z')}")

    each = {n: layers("pf", steps + settings("x", neutral, k), f"ts, stock, {r6('z', n)}") for n, (steps, neutral, k) in steps_of.items()}
    o["all_factors"] = "select * from " + " join ".join(f"({q})" + " using (ts, stock)" * (i > 0) for i, q in enumerate(each.values()))
    o["factor_engine"] = f"with zz as ({each['mean_reversion_5']}), dd as (select ts, row_number() over (order by ts) - 1 rn, count(*) over () n from (select distinct ts from zz)) select ts, stock, mean_reversion_5, case when rn < floor(n * 0.7) then 'train' when rn < floor(n * (0.7 + 0.15)) then 'cv' else 'test' end split from zz join dd using (ts)"
    x = layers("pf", [{"hl_": "high - low", "fwd": f"{lag('close', -1)} / nullif(close, 0) - 1"}, {"b_": f"(close - {lag('close', 5)}) / nullif({mean('hl_', 5)}, 0)"}, {"x": f"-pow(({xrank('b_')}) - 0.5, 3)"}], "ts, stock, close, x, fwd")
    corr = "case when count(*) >= 2 and stddev_pop({0}) > 1e-12 and stddev_pop({1}) > 1e-12 then covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) end"
    ics = f"base as ({x}), ok as (select * from base where x is not null and fwd is not null), rk as (select *, {xrank('x')} rx, {xrank('fwd')} rf_ from ok), ic as (select ts, {corr.format('x', 'fwd')} ic, {corr.format('rx', 'rf_')} rank_ic, count(*) n from rk group by ts)"
    o["ic_1d"] = f"with {ics} select ts, {r6('ic')}, n::bigint n from ic"
    o["rank_ic"] = f"with {ics} select ts, {r6('rank_ic')}, n::bigint n from ic"
    ir = "case when stddev_samp({0}) > 1e-12 then avg({0}) / stddev_samp({0}) end"
    o["icir_summary"] = f"with {ics} select 'x' factor, {r6('avg(ic)', 'ic_mean')}, {r6('stddev_samp(ic)', 'ic_sd')}, {r6(ir.format('ic'), 'icir')}, {r6('avg(rank_ic)', 'rank_ic_mean')}, {r6(ir.format('rank_ic'), 'rank_icir')}, count(ic)::bigint n_dates from ic"
    parts = []
    for n in (1, 5, 10, 30):
        parts.append(
            f"select {n} as \"interval\", {r6('avg(ic)', 'ic_mean')}, {r6(ir.format('ic'), 'icir')}, count(ic)::bigint n_dates from (select ts, {corr.format('x', 'fwd')} ic from (select * from (select *, dense_rank() over (order by ts) - 1 k from (select ts, stock, x, lead(close, {n}) over (partition by stock order by ts) / nullif(close, 0) - 1 fwd from base) where ts in (select ts from (select ts, x, lead(close, {n}) over (partition by stock order by ts) c from base) where x is not null or c is not null)) where k % {n} = 0 and x is not null and fwd is not null) group by ts)"
        )
    o["icir_intervals"] = f"with base as ({x}) " + " union all ".join(parts)
    o["coverage_filter"] = f"{p} select 'close' factor, {r6('avg((close is not null)::int)', 'coverage')} from p1 union all select 'sic_code', {r6('avg((sic_code is not null)::int)', 'coverage')} from p1"
    o["impute_medians"] = f"{p} select ts, stock, round(1.00000000001e0 * coalesce(close, quantile_cont(close, 0.5) over (partition by ts), (select quantile_cont(close, 0.5) from p1), 0), 6) + 0.0 as close from p1"
    ols = "select ts, regr_intercept(fwd, x) c, regr_slope(fwd, x) b, regr_r2(fwd, x) r2, regr_syy(fwd, x) syy, count(*) n from ok group by ts having count(*) >= 2"
    okb = f"base as ({x}), ok as (select * from base where x is not null and fwd is not null), fit as (select * from ({ols}))"
    guard = "case when isfinite({0}) then {0} end"
    o["ols_1factor"] = f"with {okb} select ts, {r6(guard.format('c'), 'const_term')}, {r6(guard.format('b'), 'beta')}, {r6(guard.format('r2'), 'rsquared')}, n::bigint n_obs from fit"
    five = f"base5 as (select * exclude (fwd), lead(close, 5) over (partition by stock order by ts) / nullif(close, 0) - 1 fwd from ({x})), ok as (select * from base5 where x is not null and fwd is not null), fit as (select * from ({ols}))"
    o["results_by_horizon"] = f"with {five} select ts, {r6(guard.format('c'), 'const_term')}, {r6(guard.format('b'), 'beta')}, {r6(guard.format('r2'), 'rsquared')}, n::bigint n_obs from fit"
    two = f"with recursive {STYLES}, ok as (select * from st where s1 is not null and s2 is not null and fwd is not null), cv as (select ts, count(*) n, avg(s1) m1, avg(s2) m2, avg(fwd) my, var_pop(s1) a, covar_pop(s1, s2) b, var_pop(s2) c, covar_pop(s1, fwd) p, covar_pop(s2, fwd) q, var_pop(fwd) v from ok group by ts having count(*) >= 3)"
    mse = "(v - 2 * (w1 * p + w2 * q) + w1 * w1 * a + 2 * w1 * w2 * b + w2 * w2 * c)"
    for kind, alpha, l1 in (("ols", 0.0, 0.0), ("ridge", 1.0, 0.0), ("lasso", 1e-4, 1.0), ("elastic_net", 1e-4, 0.5)):
        adj = f"case when n > 3 then 1 - {mse} / v * (n - 1) / (n - 3) end" if kind == "ols" else "null::double"
        o[f"{kind}_per_date"] = f"{two}, {fits(kind, alpha, l1)} select ts, {r6('my - w1 * m1 - w2 * m2', 'const_term')}, {r6('w1', 'beta_s1')}, {r6('w2', 'beta_s2')}, {r6(f'1 - {mse} / v', 'rsquared')}, {r6(adj, 'adj_rsquared')}, {r6(f'sqrt(greatest({mse}, 0))', 'rmse')}, n::bigint n_obs from ft"
    alphas = "al as (select unnest([0.001, 0.01, 0.1, 1.0, 10.0]::double[]) alpha)"
    days_ = "dz as (select ts, row_number() over (order by ts) - 1 rn, count(*) over () n from (select distinct ts from st))"
    rows_ = f"with {STYLES}, {days_}, {alphas}, ok as (select * from st join dz using (ts) where s1 is not null and s2 is not null and fwd is not null)"
    w1, w2, c0 = ridged("a")
    o["kfold_tune"] = f"{rows_}, hd as (select part, {moments('(select *, floor(rn * 5 / n)::int part from (select * exclude (n), n n_ from ok) x join (select max(n) n from dz) y on true)')} group by part), sn as (select h.part, {', '.join(f't.{c} - h.{c} {c}' for c in SUMS)} from hd h, (select {', '.join(f'sum({c}) {c}' for c in SUMS)} from hd) t), fw as (select part, alpha, {w1} w1, {w2} w2, {c0} c from sn a, al), ev as (select fw.part, alpha, {missed('h')} e from fw join hd h using (part)), mn as (select alpha, avg(e) m from ev group by alpha) select alpha, {r6('m', 'val_mse')}, m = min(m) over () best from mn"
    spans = "kk as (select unnest(range(200, (select max(n) from dz) - 50 + 1, 50)) e), okf as (select ok.*, e part from ok, kk where rn < e + 50)"
    o["walk_forward_tune"] = f"{rows_}, {spans}, sn as (select part, {moments('okf')} where rn < part group by part), hd as (select part, {moments('okf')} where rn >= part group by part), fw as (select part, alpha, {w1} w1, {w2} w2, {c0} c from sn a, al), ev as (select fw.part, alpha, {missed('s')} te, {missed('h')} ve from fw join sn s using (part) join hd h using (part)), ma as (select fw.part, alpha, avg(abs(fwd - c - w1 * s1 - w2 * s2)) mae from okf join fw using (part) where rn >= okf.part group by 1, 2), mn as (select alpha, avg(te) te, avg(ve) ve, avg(mae) mae, avg(sqrt(ve)) rm, stddev_pop(sqrt(ve)) sd from ev join ma using (part, alpha) group by alpha) select alpha, {r6('te', 'train_mse')}, {r6('ve', 'val_mse')}, {r6('mae', 'val_mae')}, {r6('rm', 'val_rmse')}, {r6('sd', 'val_rmse_sd')}, rm = min(rm) over () best from mn"
    o["factor_returns_pinv"] = f"with {RISK} select ts, k, {r6('f')} from fr where abs(f) > 1e-9"
    o["factor_residuals"] = f"with {RISK} select ts, stock, {r6('e')}, {r6('r')} from er"
    o["factor_covariance"] = f"with {RISK}, wf as {aged('fr', 63)}, mf as (select k, sum(w * f) m from fr join wf using (ts) group by k), cf as (select a.k i, b.k j, sum(w * a.f * b.f) s from fr a join fr b using (ts) join wf using (ts) group by 1, 2), cc as (select i, j, (s - x.m * y.m) / (1 - (select sum(w * w) from wf)) cov from cf join mf x on x.k = i join mf y on y.k = j) select i, j, {r6('cov')} from cc where abs(cov) > 1e-9"
    o["specific_variance"] = f"with {RISK}, le as (select * from er where ts in (select ts from (select distinct ts from er) order by ts desc limit 21)), wf as {aged('le', 21)}, sv as (select stock, greatest(0, (sum(w * e * e) - sum(w * e) * sum(w * e)) / (1 - sum(w * w))) v from le join wf using (ts) group by stock) select stock, {r6('v', 'var')} from sv"
    at = STYLES.replace("\nst as (", "\nst0 as (") + ",\nst as (select * replace (close / nullif(lag(close) over (partition by stock order by ts), 0) - 1 as r) from st0 where ts in (select ts from (select distinct ts from st0 where ts <= date '1999-06-28') order by ts desc limit 64))"
    for name, model, h in (("covariance_matrix", RISK, 1), ("covariance_matrix_as_of", RISK.replace(STYLES, at), 5)):
        fs, ss = (o[x].split(RISK + ",", 1)[1].rsplit(" select ", 1)[0] for x in ("factor_covariance", "specific_variance"))
        ex = f"ex as (select stock, unnest([0, 1, list_position({INDUSTRIES!r}, g)::int + 1]) k, unnest([s1, s2, 1.0::double]) v from rs where ts = (select max(ts) from rs))"
        v = "vv as (select a.stock stock_i, b.stock stock_j, sum(a.v * cov * b.v) c from ex a join cc on cc.i = a.k join ex b on b.k = cc.j group by 1, 2)"
        o[name] = f"with recursive {model},{fs},{ss.replace('wf', 'ws')}, {ex}, {JUDGED}, {v} select stock_i, stock_j, {r6(f'(c + case when stock_i = stock_j then sv.v else 0 end) * case when bad and stock_i <> stock_j then 0.85::double else 1 end * {h} / 1e4', 'cov')} from vv join sv on sv.stock = stock_i, jd"
    o["optimize_equal_weight_fallback"] = f"with {STYLES}, dd as (select ts, row_number() over (order by ts) - 1 k from (select distinct ts from st where s1 is not null)), ns as (select distinct stock from st) select ts, stock, {r6('1.0::double / (select count(*) from ns)', 'weight')}, 'capped' status from dd, ns where k % 30 = 0"
    o["industry_exposures"] = f"with {RISK} select stock, {r6('s1')}, {r6('s2')}, " + ", ".join(f"(g = '{n}')::int::double {n}" for n in INDUSTRIES) + " from rs where ts = (select max(ts) from rs)"
    o["predict_returns"] = f"with {okb}, m as (select avg({guard.format('c')}) c, avg({guard.format('b')}) b from fit) select ts, stock, round(1.00000000001e0 * (c + b * coalesce(x, quantile_cont(x, 0.5) over (partition by ts), (select quantile_cont(x, 0.5) from base), 0)), 6) + 0.0 prediction from base, m"
    o["walk_forward_splits"] = f"{p}, {DATES}, k as (select unnest(range(200, (select max(n) from dts) - 50 + 1, 50)) e), q as (select e, row_number() over (order by e) - 1 fold from k) select fold::int fold, a.ts train_from, b.ts train_to, c.ts val_from, d.ts val_to from q join dts a on a.rn = 0 join dts b on b.rn = e - 1 join dts c on c.rn = e join dts d on d.rn = e + 49"
    o["ewma_weights"] = f"{p}, {DATES} select ts, {r6('exp(-ln(2) / 63 * (n - 1 - rn)) / sum(exp(-ln(2) / 63 * (n - 1 - rn))) over ()', 'weight')} from dts"

    w = f"{DATES}, vw as (select p1.ts, stock, case when rn % 5 = 0 then volume / sum(volume) over (partition by p1.ts) end weight from p1 join dts using (ts))"
    sw = f"{DATES}, vw as (select p1.ts, stock, case when rn % 2 = 0 and (stock + rn // 2) % 3 <> 0 then volume / sum(volume) over (partition by p1.ts) end weight from p1 join dts using (ts))"
    kept = lambda n: f"hd as (select *, max(weight is not null) over (partition by ts) any_ from vw), hw as (select ts, stock, case when any_ then weight else last_value(weight ignore nulls) over (partition by stock order by ts rows between {n} preceding and current row) end weight from hd)"
    held = kept(2)
    o["hold_weights"] = f"{p}, {sw}, {kept(3)} select ts, stock, {r6('weight')} from hw"
    o["weights_by_horizon"] = f"{p}, {sw} select ts, stock, {r6('weight')} from vw"
    o["held_weights"] = f"{p}, {w}, fw as (select ts, stock, last_value(weight ignore nulls) over (partition by stock order by ts rows between 4 preceding and current row) weight from vw where stock in (select stock from vw where weight is not null)) select ts, stock, {r6('weight')} from fw"
    prep = f"{held}, pw as (select ts, stock, coalesce(weight / nullif(sum(weight) over (partition by ts), 0), 0) w from hw)"
    o["prepare_weights"] = f"{p}, {sw}, {kept(3)}, pw as (select ts, stock, coalesce(weight / nullif(sum(weight) over (partition by ts), 0), 0) w from hw) select ts, stock, {r6('w', 'weight')} from pw"
    scaled = sw.replace("vw as (select p1.ts, stock, case", "v0 as (select p1.ts, stock, case") + ", vw as (select ts, stock, weight * case month(ts) when 2 then 0.5::double when 3 then 2.0::double else 1.0::double end weight from v0)"
    o["weight_totals"] = f"{p}, {scaled}, {kept(3)}, tt as (select ts, sum(weight) t from hw group by ts having sum(weight) is not null) select ts, {r6('t', 'total')}, case when abs(t) < 1e-6 then 'zero' when t < 1 - 1e-6 then 'under' when t > 1 + 1e-6 then 'over' else 'one' end state from tt"
    o["unscaled_weights"] = f"{p}, {sw}, {kept(3)} select ts, stock, {r6('coalesce(weight, 0)', 'weight')} from hw"
    o["factor_cache_grows"] = o["factor_liquidity_test"]
    o["slippage_tiers"] = f"{p} select stock, row_number() over (order by stock)::int place, case when row_number() over (order by stock) <= 4 then 13.0 when row_number() over (order by stock) <= 40 then 20.0 when row_number() over (order by stock) <= 80 then 50.0 else 70.0 end::double bps from (select distinct stock from bars)"
    trades = f"{prep}, rt as (select ts, stock, close, lead(close) over (partition by stock order by ts) / nullif(close, 0) - 1 r from pf), td as (select rt.ts, rt.stock, coalesce(w, 0) w, r, close from rt left join pw on pw.ts = rt.ts and pw.stock = rt.stock where rt.ts in (select ts from rt where r is not null)), dd as (select *, w - coalesce(lag(w) over (partition by stock order by ts), 0) dw from td), dy as (select ts, sum(w * coalesce(r, 0)) gross, sum(abs(dw)) turnover from dd group by ts)"
    g = f"{f}, {w}, {trades}"
    o["gross_return"] = f"{g} select ts, {r6('gross')} from dy"
    o["turnover"] = f"{g} select ts, {r6('turnover')} from dy"
    eq = f"{g}, eq as (select ts, gross * 1e-2 gross, turnover, product(1 + gross * 1e-2) over (order by ts rows unbounded preceding) equity from dy), cv as (select *, equity / max(equity) over (order by ts rows unbounded preceding) - 1 drawdown from eq)"
    o["equity_drawdown"] = f"{eq} select ts, {r6('equity')}, {r6('drawdown')} from cv"
    div = "case when abs({1}) > 1e-15 then ({0}) / ({1}) end"
    vol, down, ul, ann = "stddev_samp(gross) * sqrt(252)", "stddev_samp(case when gross < 0 then gross end) * sqrt(252)", "sqrt(avg(drawdown * drawdown))", "avg(gross) * 252"
    o["metrics_ungated"] = f"{eq} select {r6('product(1 + gross) - 1', 'total_return')}, {r6(ann, 'annual_return')}, {r6(ann, 'annual_gross')}, {r6(vol, 'volatility')}, {r6('min(drawdown)', 'max_drawdown')}, {r6(ul, 'ulcer')}, {r6('avg(turnover)', 'avg_turnover')}, count(*)::bigint n, 0.0::double cost_drag, {r6(div.format(ann, vol), 'sharpe')}, {r6(div.format(ann, down), 'sortino')}, {r6(div.format(ann, ul), 'upi')} from cv"
    bn = f"{eq}, {BENCH}, ab as (select d.ts, coalesce((select arg_max(close, b.ts) from bench b where b.ts <= d.ts), (select arg_min(close, ts) from bench)) c from dy d), br as (select ts, c / nullif(lag(c) over (order by ts), 0) - 1 b from ab), bb as (select gross, b from eq join br using (ts) where b is not null), bm as (select covar_samp(gross, b) / nullif(var_samp(b), 0) beta, stddev_samp(gross - b) * sqrt(252) te, product(1 + b) - 1 bt, count(*) n, avg(gross) * 252 a from bb), bx as (select *, pow(1 + bt, 252.0 / n) - 1 ba from bm)"
    o["benchmark_metrics"] = f"{bn} select {r6('beta')}, {r6('a - beta * ba', 'alpha')}, {r6('te', 'tracking_error')}, {r6('bt', 'benchmark_total')}, {r6('ba', 'benchmark_annual')}, {r6('a - ba', 'active_return')}, {r6(div.format('a - ba', 'te'), 'information_ratio')} from bx"
    o["plot_series"] = f"{bn.split(', br as')[0]} select cv.ts, {r6('equity')}, {r6('drawdown')}, {r6('turnover')}, {r6('c / first_value(c) over (order by ts)', 'benchmark')} from cv join ab using (ts)"
    rp = f"{eq}, rr as (select *, equity / nullif(lag(equity) over (order by ts), 0) - 1 q from cv), rm as (select pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1 ag, stddev_samp(q) * sqrt(252) rv, min(drawdown) md from rr)"
    o["report_metrics"] = f"{rp} select {r6('ag', 'annual_geometric')}, {r6('rv', 'report_volatility')}, {r6(div.format('ag', 'rv'), 'report_sharpe')}, {r6('md', 'report_max_dd')} from rm"
    o["weight_summary"] = f"{p}, {w} select min(n)::bigint min_held, max(n)::bigint max_held, {r6('avg(m)', 'mean_largest')}, {r6('stddev_samp(m)', 'sd_largest')} from (select ts, count(weight) n, max(weight) m from vw where weight is not null group by ts)"
    calm = f"with recursive {P1F}, {w}, {prep}, rt as (select ts, stock, 900 + close * 0.001::double p, lead(900 + close * 0.001::double) over (partition by stock order by ts) / (900 + close * 0.001::double) - 1 r from pf), td as (select rt.*, coalesce(w, 0) w, dense_rank() over (order by rt.ts) di, 13.0::double bps from rt left join pw on pw.ts = rt.ts and pw.stock = rt.stock where rt.ts in (select ts from rt where r is not null)), gt as (select stock, 0::bigint di, 0.0::double t, 0.0::double dw from (select distinct stock from td) union all select td.stock, td.di, case when abs(w - t) < 0.0005 then t else w end, case when abs(w - t) < 0.0005 then 0 else w - t end from gt join td on td.stock = gt.stock and td.di = gt.di + 1)"
    bps = "case when row_number() over (order by stock) <= 500 then 13.0 when row_number() over (order by stock) <= 1500 then 20.0 else 50.0 end"
    tiers = f"bp as (select stock, {bps}::double b from (select distinct stock from td)), dy as (select td.di, td.ts, sum(t * coalesce(r, 0)) gross, sum(abs(dw)) turnover, sum(abs(dw) * b / 1e4) slip, sum(abs(least(t, 0))) short, coalesce(list(abs(dw) / p) filter (abs(dw) > 0 and p > 0), []::double[]) lots from td join gt on gt.stock = td.stock and gt.di = td.di join bp on bp.stock = td.stock group by td.di, td.ts)"
    charge = "coalesce(list_sum(list_transform(lots, lambda q: greatest(q * e * 0.005::double, 1.0::double))), 0) + (slip + short * 0.01::double / 252) * e"
    fold = f"eq as (select 0::bigint di, 1e6::double nxt, 0.0::double e, 0.0::double cost, 0.0::double net union all select di, e * (1 + gross - cost / e), e, cost, gross - cost / e from (select dy.di, gross, nxt e, {charge.replace(' e ', ' nxt ').replace('* e', '* nxt')} cost from eq join dy on dy.di = eq.di + 1))"
    o["backtest_gated_costs"] = f"{calm}, {tiers}, {fold} select dy.ts, {r6('gross')}, {r6('net')}, {r6('turnover')}, {r6('eq.cost / 1e6', 'cost')}, {r6('e / 1e6', 'equity')} from eq join dy using (di)"
    o["event_bars"] = "select date_trunc('hour', ts) start, event_type, " + r6("arg_min(value, (ts, value))", '"open"') + ", " + r6("max(value)", "high") + ", " + r6("min(value)", "low") + ", " + r6("arg_max(value, (ts, value))", '"close"') + ", count(*)::bigint n from events group by 1, 2"
    o["stream_upsert"] = f"{p} select ts, stock, {r6('close')} from bars"
    o["snapshot_as_of"] = f"{p} select ts, stock, {r6('close')}, {r6('case when ts >= (select max(ts) from bars) - 60 then close * 2 else close end', 'now')} from bars"
    o["stream_out_of_order"] = f"{p} select ts, stock, {r6('close')}, {r6('close / lag(close) over (partition by stock order by ts) - 1', 'ret')} from bars"
    o["landed_bars"] = f"{p} select ts, 'S' || stock stock, {bars6} from bars where ts >= date '1995-01-01'"
    o["landed_bars_stream"] = f"{p} select ts, 'S' || stock stock, {r6('close')} from bars"
    o["landed_statements"] = """with l as (select cast(date_trunc('month', l_shipdate) as date) ts, unnest([l_suppkey, l_suppkey + 1])::varchar stock, ((l_orderkey * 8 + l_linenumber) * 100 + l_quantity::bigint) * 100000000 + round(l_extendedprice * 100)::bigint seq,
      case when l_linenumber % 3 > 0 then l_quantity end q, case when l_linenumber % 2 = 0 then l_extendedprice end e from lineitem where l_linenumber < 7)
      select ts, stock, """ + r6("arg_max(q, seq) filter (q is not null)", "net_income") + ", " + r6("arg_max(e, seq) filter (e is not null)", "ebitda") + " from l group by 1, 2"
    o["wide_csv"] = f"{p} select ts, stock, {r6('close')}, {r6('volume')}, {r6('total_liabilities')} from p1"
    o["written_panel"] = f"{p} select ts, stock, {r6('close')} from bars where year(ts) between 1994 and 1995"
    o["read_or_empty"] = f"{p} select ts, stock, {r6('close')} from bars"
    o["column_order"] = f"{p} select ts, stock, " + ", ".join(r6(c) for c in ('"open"', "close", "volume", "vwap")) + " from bars"
    o["bfill"] = f"{p} select ts, stock, {r6('first_value(close ignore nulls) over (partition by stock order by ts rows between current row and unbounded following)', 'v')} from p1"
    return o
