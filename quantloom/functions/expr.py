"""Nested expressions over panels: `-rank(zscore(ret, 252))` as it is read.

An expression is a small tree. Its nodes are cells (functions of one row),
windows over a stock's rows in time, and windows over the stocks of a date. A
window can't hold another in Spark, so computed() gives every window node a
column in an earlier step, and takes the steps of all expressions together:
windows over time first, those over stocks after them, over time again, and so
on. Nodes that are equal are made once, whichever expressions hold them.

Windows over time are linear in the rows, whatever their length w (short ones
are gone through for each row, which costs less). Rows are cut into blocks of w;
a window is the end of one block and the beginning of the next, so its sum is a
running sum from the block's end, looked up w - 1 rows back, and one from the
next block's beginning. Only values of the window take part: one that is huge,
or not a number, is gone when it leaves the window.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions import scalar as sc
from quantloom.functions import xs
from quantloom.functions.ts import by_stock, rows

CELL, TIME, STOCKS, ORDER = "cell", "time", "stocks", "order"
#: Windows up to this length are gone through for each row, which costs less than blocks; the values that take part are the same.
SHORT = 32
#: Rows of a stock that time ranks are computed on together, at least.
CHUNK = 4096


@dataclass(frozen=True, eq=False)
class Expr:
    """key tells what a node computes; make gives its Column from those of its parts;
    reach is how many rows before the current one it depends on."""

    kind: str
    key: tuple
    parts: tuple[Expr, ...] = ()
    make: Callable[..., Column] = field(default=None, repr=False)
    reach: int = 0

    def __eq__(self, other):
        raise TypeError("compare expressions with equals()")

    __hash__ = None

    def __add__(self, other):
        return _cell("+", lambda a, b: a + b, self, other)

    def __radd__(self, other):
        return lit(other) + self

    def __sub__(self, other):
        return _cell("-", lambda a, b: a - b, self, other)

    def __rsub__(self, other):
        return lit(other) - self

    def __mul__(self, other):
        return _cell("*", lambda a, b: a * b, self, other)

    def __rmul__(self, other):
        return lit(other) * self

    def __truediv__(self, other):
        """Null where the divisor is zero or null."""
        return _cell("/", sc.ratio, self, other)

    def __rtruediv__(self, other):
        return lit(other) / self

    def __pow__(self, n: float):
        return _cell(f"pow {n}", lambda a: F.pow(a, F.lit(float(n))), self)

    def __neg__(self):
        return _cell("neg", lambda a: -a, self)

    def __gt__(self, other):
        return _cell(">", lambda a, b: a > b, self, other)

    def __lt__(self, other):
        return _cell("<", lambda a, b: a < b, self, other)

    def equals(self, other):
        return _cell("=", lambda a, b: a == b, self, other)


def _expr(x) -> Expr:
    return x if isinstance(x, Expr) else c(x) if isinstance(x, str) else lit(x)


def _node(kind: str, name: str, make: Callable[..., Column], *parts, reach: int = 0) -> Expr:
    parts = tuple(map(_expr, parts))
    return Expr(kind, (kind, name, *(p.key for p in parts)), parts, make, reach + max((p.reach for p in parts), default=0))


def _cell(name: str, make: Callable[..., Column], *parts) -> Expr:
    return _node(CELL, name, make, *parts)


def c(name: str) -> Expr:
    """A column of the panel."""
    return Expr(CELL, (CELL, "column", name), (), lambda: F.col(f"`{name}`"))


def lit(x: float) -> Expr:
    return Expr(CELL, (CELL, "value", float(x)), (), lambda: F.lit(float(x)))


# functions of one cell


def cell(name: str, make: Callable[..., Column], *parts) -> Expr:
    """Any function of Columns; the name tells it from others."""
    return _cell(f"f {name}", make, *parts)


def ln(x) -> Expr:
    """Null for zero and less."""
    return _cell("ln", F.ln, x)


def abs_(x) -> Expr:
    return _cell("abs", F.abs, x)


def some(x) -> Expr:
    """x as a double; zero, NaN and infinities are null."""
    return _cell("some", lambda a: F.nullif(sc.clean(a), F.lit(0.0)), x)


def indicator(condition: Expr) -> Expr:
    """1 where it holds, else (null too) 0."""
    return _cell("indicator", sc.indicator, condition)


def or_zero(x) -> Expr:
    return _cell("or zero", lambda a: F.coalesce(a, F.lit(0.0)), x)


def both(condition: Expr, x) -> Expr:
    """x where the condition holds, else null."""
    return _cell("where", lambda a, b: F.when(a, b), condition, x)


# over a stock's rows


def _time(name: str, make: Callable[..., Column], *parts, reach: int = 0) -> Expr:
    return _node(TIME, name, make, *parts, reach=reach)


def delay(x, n: int) -> Expr:
    return _time(f"lag {n}", lambda a: F.lag(a, n).over(by_stock()) if n >= 0 else F.lead(a, -n).over(by_stock()), x, reach=max(n, 0))


def delta(x, n: int) -> Expr:
    x = _expr(x)
    return x - delay(x, n)


def returns(x="close", n: int = 1) -> Expr:
    x = _expr(x)
    return x / delay(x, n) - 1


def row() -> Expr:
    """A row's place among its stock's, from 0."""
    return _time("row", lambda: F.row_number().over(by_stock()) - 1)


def _block(w: int, back: bool):
    """A block of w rows up to the current one (column _row), from its beginning or its end."""
    whole = lambda n: Window.partitionBy("stock", F.floor(n / w))
    return lambda n: whole(n).orderBy(F.col("ts").desc() if back else F.col("ts")).rowsBetween(Window.unboundedPreceding, 0)


def _scan(name: str, agg: Callable[..., Column], x: Expr, w: int) -> tuple[Expr, Expr]:
    """agg of a window's part in its last row's block, and in the block before. The second is null where there is none."""
    head = _time(f"head {w} {name}", lambda a, n: agg(a, n).over(_block(w, False)(n)), x, row(), reach=w - 1)
    tail = _time(f"tail {w} {name}", lambda a, n: agg(a, n).over(_block(w, True)(n)), x, row())
    return head, _cell(f"unless at {w}", lambda a, n: F.when(n % w != w - 1, a), delay(tail, w - 1), row())


def _frame(name: str, agg: Callable[[Column], Column], x: Expr, w: int) -> Expr:
    """agg of a full window that is short enough to be gone through for each row."""
    return _time(f"frame {name}", lambda a: F.when(F.count(a).over(rows(w)) == w, agg(a).over(rows(w))), x, reach=w - 1)


def full(x, w: int) -> Expr:
    """Whether all of the last w values are there."""
    gap = _time("gap", lambda a, n: F.max(F.when(a.isNull(), n)).over(by_stock().rowsBetween(Window.unboundedPreceding, 0)), x, row())
    return _cell(f"full {w}", lambda g, n: n - F.coalesce(g, F.lit(-1)) >= w, gap, row())


def sum_(x, w: int, missing: float | None = 0.0) -> Expr:
    """A window that is not full gives `missing`."""
    x = _expr(x)
    if w <= SHORT:
        total = _frame(f"sum {w}", lambda a: F.sum(a), x, w)
    else:
        head, tail = _scan("sum", lambda a, n: F.sum(a), x, w)
        total = both(full(x, w), head + or_zero(tail))
    return total if missing is None else _cell(f"or {missing}", lambda a: F.coalesce(a, F.lit(float(missing))), total)


def mean(x, w: int) -> Expr:
    return sum_(x, w, None) / w


def std(x, w: int) -> Expr:
    """Deviations of the two parts from their own means, and of these from each other."""
    x = _expr(x)
    if w <= SHORT:
        return _frame(f"std {w}", lambda a: F.stddev_samp(a), x, w)
    (m1, m2), (v1, v2) = _scan("avg", lambda a, n: F.avg(a), x, w), _scan("var", lambda a, n: F.var_pop(a), x, w)

    def joined(ok, m1, m2, v1, v2, n):
        k = (n % w + 1).cast("double")
        apart = F.coalesce((w - k) * v2 + (m1 - m2) * (m1 - m2) * k * (w - k) / w, F.lit(0.0))
        return F.when(ok, F.sqrt(F.try_divide(k * v1 + apart, F.lit(float(w - 1)))))

    return _cell(f"std {w}", joined, full(x, w), m1, m2, v1, v2, row())


def zscore(x, w: int) -> Expr:
    """Null where the window is constant."""
    x, sd = _expr(x), std(x, w)
    return (x - mean(x, w)) / both(sd > 1e-12, sd)


def ewm(x, w: int, halflife: float) -> Expr:
    """Mean of the window with weights that halve every `halflife` rows back. Within a
    block values are weighed from its end, so running sums only need rescaling."""
    if w > 900 * halflife:
        raise ValueError("a window of more than 900 halflives has weights that no double holds")
    x, lam = _expr(x), 0.5 ** (1 / halflife)
    head, tail = _scan(f"weighed {halflife}", lambda a, n: F.sum(a * F.pow(F.lit(lam), w - 1 - n % w)), x, w)
    norm = math.fsum(lam**i for i in range(w))

    def joined(ok, a, b, n):
        return F.when(ok, (a * F.pow(F.lit(lam), n % w - (w - 1)) + F.coalesce(b * F.pow(F.lit(lam), n % w + 1), F.lit(0.0))) / norm)

    return _cell(f"ewm {w} {halflife}", joined, full(x, w), head, tail, row())


def decay(x, n: int, newest_first: bool = False) -> Expr:
    """Linear weights over n rows: n for the oldest, 1 for the newest (or the other way)."""
    x = _expr(x)
    weights = [2 * (i + 1 if newest_first else n - i) / (n * (n + 1)) for i in range(n)]
    return x if n < 2 else sum((delay(x, n - 1 - i) * v for i, v in enumerate(weights[1:-1], 1)), delay(x, n - 1) * weights[0]) + x * weights[-1]


def rank_in_time(x, w: int) -> Expr:
    """The share of the other values of the window that are smaller."""
    return _node(ORDER, f"rank {w}", None, x, row(), reach=w - 1)


# over a date's stocks


def _stocks(name: str, make: Callable[..., Column], *parts) -> Expr:
    return _node(STOCKS, name, make, *parts)


def rank(x, digits: int | None = 9) -> Expr:
    """Values that agree when rounded to so many places are ties: sums in another order differ in later ones."""
    return _stocks(f"rank {digits}", lambda a: xs.rank(a, digits), x)


def standard(x) -> Expr:
    return _stocks("standard", xs.zscore, x)


def neutral(x, group=None) -> Expr:
    return _stocks("neutral", xs.neutralize, x) if group is None else _stocks("neutral by", xs.neutralize, x, group)


def winsor(x, low: float = 0.01, high: float = 0.99) -> Expr:
    return _stocks(f"winsor {low} {high}", lambda a: xs.winsorize(a, low, high), x)


# steps


def time_ranks(df: DataFrame, of: dict[str, tuple[str, int]], place: str) -> DataFrame:
    """df with the columns of `of`: the share of smaller values among the others of the last
    w of a column (name: (column, w)); place: the row's number in its stock.

    A stock's rows are cut into chunks, each of which also gets the rows that its
    first windows reach back to, so that one long series is the work of many
    tasks. Within, values are kept sorted as the window moves: a search, an
    insertion and a removal a row.
    """
    reach = max(w for _, w in of.values())
    size = max(CHUNK, 4 * reach)
    n = F.col(place)
    chunk = F.floor(n / size).cast("long")
    after = F.when(n % size > size - reach, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    cut = df.withColumn("_chunk", F.explode(after)).repartition("stock", "_chunk").sortWithinPartitions("stock", "_chunk", place)
    names, columns = df.columns, list(of.items())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, sorted_ = None, [], []
        for b in batches:
            stock, chunks, places = (b.column(x).to_pylist() for x in ("stock", "_chunk", place))
            values = [b.column(x).to_pylist() for _, (x, _) in columns]
            out: list[list] = [[] for _ in columns]
            own = []
            for i, key in enumerate(zip(stock, chunks, strict=True)):
                if key != now:
                    now, windows, sorted_ = key, [[] for _ in columns], [[] for _ in columns]
                own.append(places[i] // size == chunks[i])
                for k, (_, (_, w)) in enumerate(columns):
                    held, line, v = windows[k], sorted_[k], values[k][i]
                    v = None if v is None or math.isnan(v) else v
                    if len(held) == w:
                        old = held.pop(0)
                        if old is not None:
                            line.pop(bisect.bisect_left(line, old))
                    held.append(v)
                    at = None
                    if v is not None:
                        at = bisect.bisect_left(line, v)
                        line.insert(at, v)
                    out[k].append(at / (w - 1) if at is not None and len(line) == w > 1 else None)
            made = pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *(pa.array(x, pa.float64()) for x in out)], [*names, *(x for x, _ in columns)])
            yield made.filter(pa.array(own))

    schema = StructType([*df.schema.fields, *(StructField(x, DoubleType()) for x in of)])
    return cut.mapInArrow(each, schema)


class _Steps:
    """Names for window nodes, and the step in which each is made."""

    def __init__(self):
        self.names: dict[tuple, str] = {}
        self.at: dict[tuple, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], list[Expr]] = {}

    def place(self, e: Expr) -> tuple[int, int]:
        """(stage, step) after which e can be used; stages over time are even."""
        if e.key in self.at:
            return self.at[e.key]
        stage, step = max((self.place(p) for p in e.parts), default=(0, 0))
        if e.kind != CELL:
            odd = int(e.kind == STOCKS)
            stage, step = (stage, step + 1) if stage % 2 == odd else (stage + 1, 1)
            self.names[e.key] = f"_e{len(self.names)}"
            self.made.setdefault((stage, step), []).append(e)
        self.at[e.key] = stage, step
        return stage, step

    def late(self) -> None:
        """Ranks in time, which deal the rows out anew, come last in their stage where nothing else in it needs them."""
        for at in [x for x, nodes in self.made.items() if any(n.kind == ORDER for n in nodes)]:
            mine = [n for n in self.made[at] if n.kind == ORDER]
            used = {p for x, nodes in self.made.items() if x[0] == at[0] for n in nodes for p in self.inputs(n)}
            if not any(self.names[n.key] in used for n in mine):
                self.made[at] = [n for n in self.made[at] if n.kind != ORDER]
                self.made.setdefault((at[0], 1 + max(x[1] for x in self.made if x[0] == at[0])), []).extend(mine)

    def inputs(self, e: Expr) -> set[str]:
        """Columns that a node reads when it is made."""
        found: set[str] = set()

        def walk(p: Expr) -> None:
            if p.key in self.names:
                found.add(self.names[p.key])
            elif p.key[1] == "column":
                found.add(p.key[2])
            else:
                for q in p.parts:
                    walk(q)

        for p in e.parts:
            walk(p)
        return found

    def column(self, e: Expr) -> Column:
        return F.col(self.names[e.key]) if e.key in self.names else self.own(e)

    def own(self, e: Expr) -> Column:
        return e.make(*map(self.column, e.parts))

    def settled(self, outputs: list[Expr], open_: list[Expr], have: set[str]) -> dict[str, Column]:
        """Columns for the cells that the nodes which aren't made yet and the outputs read and
        that can be made of the columns that are there, so that these go through
        the next exchange and not all that they are made of."""
        found: dict[tuple, Expr] = {}

        def ready(e: Expr) -> bool:
            return self.names[e.key] in have if e.key in self.names else all(map(ready, e.parts))

        def walk(e: Expr) -> None:
            if e.key in self.names or not e.parts:
                return
            if e.kind == CELL and ready(e):
                found[e.key] = e
            else:
                for p in e.parts:
                    walk(p)

        for e in (*(p for n in open_ for p in n.parts), *outputs):
            walk(e)
        made = {f"_c{len(self.names) + i}": e for i, e in enumerate(found.values())}
        columns = {name: self.own(e) for name, e in made.items()}
        self.names.update({e.key: name for name, e in made.items()})
        return columns

    def needed(self, outputs: list[Expr], at: tuple[int, int]) -> set[str]:
        """Columns, of the panel and made, that this step, later ones and the outputs read."""
        whole = Expr(CELL, (CELL, "all"), tuple(outputs))
        return self.inputs(whole).union(*(self.inputs(e) for x, nodes in self.made.items() if x >= at for e in nodes))


def _spec(e: Expr) -> tuple:
    """Window nodes of one step that sort the rows alike have the same."""
    name = e.key[1].split()
    if e.kind == TIME:
        return tuple(name[:2]) if name[0] in ("head", "tail") else ()
    return e.key if name[0] == "rank" else e.parts[1].key if name[:2] == ["neutral", "by"] else ()


def _widened(df: DataFrame, nodes: list[Expr], steps: _Steps) -> DataFrame:
    """df with a column for each window node. A window copies its rows column by column, which costs more than
    its functions where there are many columns; so those that the others read or made go by in arrays."""
    groups: dict[tuple, list[Expr]] = {}
    for e in nodes:
        groups.setdefault(_spec(e), []).append(e)
    if len(groups) < 2:
        return df.withColumns({steps.names[e.key]: steps.own(e) for e in nodes})
    order, place = df.columns, {}  # where a packed column lies: array, position

    def packed(df: DataFrame, drop: set[str]) -> DataFrame:
        new = [x for x, t in df.dtypes if t == "double" and x not in drop]
        name = f"_pack{len(place)}"
        place.update({x: (name, i) for i, x in enumerate(new)})
        rest = [F.col(f"`{x}`") for x in df.columns if x not in drop and x not in new]
        return df.select(*rest, F.array(*[F.col(f"`{x}`") for x in new]).alias(name)) if new else df.select(*rest)

    def unpacked(x: str) -> Column:
        return F.get(F.col(place[x][0]), F.lit(place[x][1]))

    df = packed(df, set())
    for group in groups.values():
        read = {x for e in group for x in steps.inputs(e)} & place.keys()
        df = df.withColumns({x: unpacked(x) for x in read}).withColumns({steps.names[e.key]: steps.own(e) for e in group})
        df = packed(df, read)
    made = [steps.names[e.key] for g in groups.values() for e in g]
    return df.select(*[unpacked(x).alias(x) if x in place else F.col(f"`{x}`") for x in (*order, *made)])


def computed(df: DataFrame, outputs: dict[str, Expr], keep: tuple[str, ...] = ()) -> DataFrame:
    """ts, stock, the columns `keep`, and a column for each expression. df: a panel with a
    row for each date and stock. Whatever their number, the expressions share their
    exchanges: one for each change between windows over time and over stocks."""
    steps = _Steps()
    for e in outputs.values():
        steps.place(e)
    steps.late()
    stage, results = 0, list(outputs.values())
    for at in sorted(x for x, nodes in steps.made.items() if nodes):
        if at[0] != stage or any(e.kind == ORDER for e in steps.made[at]):
            df = df.withColumns(steps.settled(results, [e for x, nodes in steps.made.items() if x >= at for e in nodes], set(df.columns)))
        names = steps.needed(results, at)
        df = df.select("ts", "stock", *[F.col(f"`{x}`") for x in df.columns if x not in ("ts", "stock") and (x in names or x in keep)])
        if at[0] != stage:
            stage = at[0]
            if stage % 2:  # windows by date and group then need no exchange of their own
                df = df.repartition("ts")
        windows = [e for e in steps.made[at] if e.kind != ORDER]
        df = _widened(df, windows, steps) if windows else df
        orders = [e for e in steps.made[at] if e.kind == ORDER]
        if orders:
            inputs = {f"{steps.names[e.key]}x": steps.column(e.parts[0]).cast("double") for e in orders}
            of = {steps.names[e.key]: (f"{steps.names[e.key]}x", int(e.key[1].split()[1])) for e in orders}
            df = time_ranks(df.withColumns(inputs), of, steps.names[row().key]).drop(*inputs)
    return df.select("ts", "stock", *[F.col(f"`{x}`") for x in keep], *[steps.column(e).alias(x) for x, e in outputs.items()])
