"""Panel formulas as expression trees, and their two readings: Spark columns and SQL.

A panel is long: one row per (code, date), one column per metric. `ts_*` functions look back over the bars of a code,
`rank`, `scale` and `indneutralize` across the codes of a date. A rolling function needs as many values as its window
has bars; windows may be fractional and round half up, to one bar at least. Division by zero, logarithms of what is
not positive, and powers that are not real are NULL; a comparison with NULL is false.

Window functions can't be nested in one projection, so `with_formula` adds them level by level: all functions of one
level share a projection, equal subtrees are computed once, and a level costs a shuffle only where it changes between
codes and dates. Rolling means, deviations and correlations are rounded to `DIGITS` digits, so that values that are
equal in exact arithmetic stay ties when they are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

DIGITS = 10
CODE, DATE = "code", "date"


def bars(n: float) -> int:
    return max(1, math.floor(n + 0.5))


class X:
    """A node: what it does, its operands, and its parameter."""

    def __init__(self, op: str, *args: "X", par=None):
        self.op, self.args, self.par = op, args, par
        self.key = f"{op}[{par}]({','.join(a.key for a in args)})" if args or par is not None else op

    def __add__(self, o): return X("+", self, lift(o))
    def __radd__(self, o): return X("+", lift(o), self)
    def __sub__(self, o): return X("-", self, lift(o))
    def __rsub__(self, o): return X("-", lift(o), self)
    def __mul__(self, o): return X("*", self, lift(o))
    def __rmul__(self, o): return X("*", lift(o), self)
    def __truediv__(self, o): return X("/", self, lift(o))
    def __rtruediv__(self, o): return X("/", lift(o), self)
    def __pow__(self, o): return X("pow", self, lift(o))
    def __neg__(self): return X("*", lift(-1), self)
    def __lt__(self, o): return X("<", self, lift(o))
    def __gt__(self, o): return X("<", lift(o), self)
    def __le__(self, o): return X("<=", self, lift(o))
    def __ge__(self, o): return X("<=", lift(o), self)

    @property
    def windowed(self) -> bool:
        return self.op in _CODE_OPS or self.op in _DATE_OPS


def lift(x) -> X:
    return x if isinstance(x, X) else X("const", par=float(x))


def col(name: str) -> X:
    return X("col", par=name)


_CODE_OPS = {"lag", "min", "max", "sum", "mean", "std", "product", "argmax", "argmin", "ts_rank", "decay", "corr", "cov", "half_mean"}
_DATE_OPS = {"rank", "scale", "demean"}


def _rolling(op: str) -> Callable:
    return lambda x, n: X(op, lift(x), par=bars(n))


ts_min, ts_max, ts_sum, ts_mean, stddev, product = (_rolling(o) for o in ("min", "max", "sum", "mean", "std", "product"))
ts_half_mean = _rolling("half_mean")  # the mean of what a window has, if that is half of it at least
ts_argmax, ts_argmin, ts_rank, decay_linear = (_rolling(o) for o in ("argmax", "argmin", "ts_rank", "decay"))


def delay(x, n): return X("lag", lift(x), par=bars(n))
def delta(x, n): return lift(x) - delay(x, n)
def correlation(x, y, n): return X("corr", lift(x), lift(y), par=bars(n))
def covariance(x, y, n): return X("cov", lift(x), lift(y), par=bars(n))
def rank(x): return X("rank", lift(x))
def scale(x, a=1.0): return X("scale", lift(x), par=float(a))
def indneutralize(x, group): return X("demean", lift(x), par=group)
def sign(x): return X("sign", lift(x))
def abs_(x): return X("abs", lift(x))
def log(x): return X("log", lift(x))
def signedpower(x, p): return X("signedpower", lift(x), lift(p))
def where(c, a, b): return X("where", lift(c), lift(a), lift(b))
def least(a, b): return X("least", lift(a), lift(b))
def greatest(a, b): return X("greatest", lift(a), lift(b))
def adv(n): return ts_mean(col("amount"), n)


def _levels(root: X) -> list[list[X]]:
    """The windowed nodes, each after those it needs, in as few groups as they allow."""
    depth: dict[str, int] = {}
    nodes: dict[str, X] = {}

    def visit(x: X) -> int:
        if x.key not in depth:
            below = max((visit(a) for a in x.args), default=0)
            depth[x.key] = below + x.windowed
            nodes[x.key] = x
        return depth[x.key]

    visit(root)
    out: list[list[X]] = []
    for k in sorted({d for key, d in depth.items() if nodes[key].windowed}):
        out.append([x for key, x in nodes.items() if x.windowed and depth[key] == k])
    return out


# ---- Spark -------------------------------------------------------------------------------------------------------


def rounded(x: Column, digits: int = DIGITS) -> Column:
    """x rounded as the SQL engine does it, by whole multiples. Spark's round reads x as a decimal, whose last digit differs in 1 of
    200 sums of five prices; ranks see that where two sums hardly differ."""
    return F.round(x * float(10**digits), 0) / float(10**digits)


def _power(x: Column, y: Column) -> Column:
    """x ** y by the C library, as in the SQL engine. Spark's own power differs from it by a last digit in 3 of 100 values; of
    large results that can decide a rounding. For exponents that vary, as results of a fixed one stay small."""

    def powers(x: pd.Series, y: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            out = np.power(x.to_numpy(float), y.to_numpy(float))
        inner = (out > 1e-300) & (out < 1e300) & (x.to_numpy(float) > 0)  # beyond, and of 0, math.pow may raise
        out[inner] = [math.pow(a, b) for a, b in zip(x[inner].tolist(), y[inner].tolist())]
        return pd.Series(out)

    return F.pandas_udf(powers, DoubleType())(x, y)


def _column(x: X, named: dict[str, str]) -> Column:
    if x.key in named:
        return F.col(named[x.key])
    a = [_condition(x.args[0], named), *(_column(y, named) for y in x.args[1:])] if x.op == "where" else [_column(y, named) for y in x.args]
    match x.op:
        case "const":
            return F.lit(x.par)
        case "col":
            return F.col(x.par)
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return F.try_divide(a[0], a[1])
        case "<" | "<=":
            return _condition(x, named).cast("double")
        case "pow":
            p = F.pow(a[0], a[1])
            return F.when(~F.isnan(p) & (F.abs(p) < float("inf")), p)
        case "signedpower":
            return F.signum(a[0]) * (F.pow if x.args[1].op == "const" else _power)(F.abs(a[0]), a[1])
        case "sign":
            return F.signum(a[0])
        case "abs":
            return F.abs(a[0])
        case "log":
            return F.when(a[0] > 0, F.ln(a[0]))
        case "where":
            return F.when(a[0], a[1]).otherwise(a[2])
        case "least" | "greatest":
            both = a[0].isNotNull() & a[1].isNotNull()
            return F.when(both, F.least(*a) if x.op == "least" else F.greatest(*a))
    raise ValueError(x.op)


def _condition(x: X, named: dict[str, str]) -> Column:
    if x.op in ("<", "<="):
        a, b = (_column(y, named) for y in x.args)
        return F.coalesce(a < b if x.op == "<" else a <= b, F.lit(False))
    return F.coalesce(_column(x, named) != 0, F.lit(False))


def _windowed(x: X, a: list[Column], names: list[str]) -> Column:
    n = x.par
    code = Window.partitionBy(CODE).orderBy(DATE)
    date = Window.partitionBy(DATE)
    if x.op == "lag":
        return F.lag(a[0], n).over(code)
    if x.op == "rank":
        # NULLs have a partition of their own; ties share the mean of their places: one exchange and one sort for it all
        own = Window.partitionBy(DATE, a[0].isNull())
        ties = own.orderBy(a[0]).rangeBetween(Window.currentRow, Window.currentRow)
        place = F.rank().over(own.orderBy(a[0])) + (F.count(F.lit(1)).over(ties) - 1) / 2
        return F.when(a[0].isNotNull(), place / F.count(F.lit(1)).over(own))
    if x.op == "scale":
        return rounded(F.try_divide(a[0] * n, F.sum(F.abs(a[0])).over(date)))
    if x.op == "demean":
        group = F.col(n)
        return F.when(group.isNotNull(), rounded(a[0] - F.avg(a[0]).over(Window.partitionBy(DATE, group))))
    w = code.rowsBetween(-(n - 1), 0)
    if x.op in ("corr", "cov"):
        u, v = F.when(a[1].isNotNull(), a[0]), F.when(a[0].isNotNull(), a[1])
        full = F.count(u).over(w) == n
        cov = F.covar_samp(u, v).over(w)
        if n == 2:  # by running means, as in SQL: of bars that hardly differ, their digits decide the last ones of the result
            du, dv = u - F.lag(u).over(code), v - F.lag(v).over(code)
            left_u, left_v = u - (F.lag(u).over(code) + du / 2), v - (F.lag(v).over(code) + dv / 2)
            cov = dv * left_u
        if x.op == "cov":
            return F.when(full, rounded(cov))
        spread = F.sqrt(left_u * du) * F.sqrt(left_v * dv) if n == 2 else F.stddev_samp(u).over(w) * F.stddev_samp(v).over(w)
        return F.when(full & (spread > 1e-12), rounded(cov / spread))
    if x.op == "half_mean":
        return F.when(F.count(a[0]).over(w) >= n // 2, rounded(F.avg(a[0]).over(w)))
    full = F.count(a[0]).over(w) == n
    held = F.collect_list(a[0]).over(w)
    match x.op:
        case "min":
            out = F.min(a[0]).over(w)
        case "max":
            out = F.max(a[0]).over(w)
        case "sum":
            out = rounded(F.sum(a[0]).over(w))
        case "mean":
            out = rounded(F.avg(a[0]).over(w))
        case "std":
            out = rounded(F.stddev_samp(a[0]).over(w))
        case "product":
            out = rounded(F.aggregate(held, F.lit(1.0), lambda p, v: p * v))
        case "argmax":
            out = F.array_position(held, F.array_max(held)).cast("double")
        case "argmin":
            out = F.array_position(held, F.array_min(held)).cast("double")
        case "ts_rank":
            out = (F.size(F.filter(held, lambda v: v < a[0])) + (F.size(F.filter(held, lambda v: v == a[0])) + 1) / 2) / n
        case "decay":
            out = rounded(sum((F.lag(a[0], k).over(code) if k else a[0]) * float(n - k) for k in range(n)) / (n * (n + 1) / 2.0))
        case _:
            raise ValueError(x.op)
    return F.when(full, out)


def with_formula(panel: DataFrame, formula: X, name: str = "factor", keep: tuple[str, ...] = ()) -> DataFrame:
    """code, date, `keep` and the formula's value, for each row of the panel."""
    named: dict[str, str] = {}
    df = panel
    for level in _levels(formula):
        inputs = {}
        operands: dict[str, list[str]] = {}
        for x in level:
            operands[x.key] = []
            for y in x.args:
                if y.key in named or y.op == "col":
                    operands[x.key].append(named.get(y.key, y.par))
                    continue
                if y.key not in inputs:
                    inputs[y.key] = (f"__v{len(named) + len(inputs)}", _column(y, named))
                operands[x.key].append(inputs[y.key][0])
        if inputs:
            df = df.withColumns(dict(inputs.values()))
            named |= {k: v[0] for k, v in inputs.items()}
        for kind in (_CODE_OPS, _DATE_OPS):  # one projection for codes, one for dates
            new = {}
            for x in level:
                if x.op in kind:
                    new[f"__v{len(named) + len(new)}"] = (x, _windowed(x, [F.col(c) for c in operands[x.key]], operands[x.key]))
            if new:
                df = df.withColumns({k: c for k, (_, c) in new.items()})
                named |= {x.key: k for k, (x, _) in new.items()}
    return df.select(CODE, DATE, *keep, _column(formula, named).alias(name))


# ---- SQL ---------------------------------------------------------------------------------------------------------


def _sql(x: X, named: dict[str, str]) -> str:
    if x.key in named:
        return named[x.key]
    a = [_sql_condition(x.args[0], named), *(_sql(y, named) for y in x.args[1:])] if x.op == "where" else [_sql(y, named) for y in x.args]
    match x.op:
        case "const":
            return f"({x.par!r})"
        case "col":
            return x.par
        case "+" | "-" | "*":
            return f"({a[0]} {x.op} {a[1]})"
        case "/":
            return f"({a[0]} / nullif({a[1]}, 0.0))"
        case "<" | "<=":
            return f"(CASE WHEN {_sql_condition(x, named)} THEN 1.0 ELSE 0.0 END)"
        case "pow":
            return f"(CASE WHEN isfinite(pow({a[0]}, {a[1]})) THEN pow({a[0]}, {a[1]}) END)"
        case "signedpower":
            return f"(sign({a[0]}) * pow(abs({a[0]}), {a[1]}))"
        case "sign":
            return f"CAST(sign({a[0]}) AS DOUBLE)"
        case "abs":
            return f"abs({a[0]})"
        case "log":
            return f"(CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END)"
        case "where":
            return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
        case "least" | "greatest":
            return f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN {x.op}({a[0]}, {a[1]}) END)"
    raise ValueError(x.op)


def _sql_condition(x: X, named: dict[str, str]) -> str:
    if x.op in ("<", "<="):
        a, b = (_sql(y, named) for y in x.args)
        return f"coalesce({a} {x.op} {b}, FALSE)"
    return f"coalesce({_sql(x, named)} <> 0, FALSE)"


def _sql_windowed(x: X, a: list[str]) -> str:
    n = x.par
    code, date = f"PARTITION BY {CODE} ORDER BY {DATE}", f"PARTITION BY {DATE}"
    if x.op == "lag":
        return f"lag({a[0]}, {n}) OVER ({code})"
    if x.op == "rank":
        own = f"PARTITION BY {DATE}, {a[0]} IS NULL ORDER BY {a[0]}"
        return f"CASE WHEN {a[0]} IS NOT NULL THEN (rank() OVER ({own}) + (count(*) OVER (PARTITION BY {DATE}, {a[0]}) - 1) / 2.0) / CAST(count({a[0]}) OVER ({date}) AS DOUBLE) END"
    if x.op == "scale":
        return f"round({a[0]} * {n!r} / nullif(sum(abs({a[0]})) OVER ({date}), 0.0), {DIGITS})"
    if x.op == "demean":
        return f"CASE WHEN {n} IS NOT NULL THEN round({a[0]} - avg({a[0]}) OVER (PARTITION BY {DATE}, {n}), {DIGITS}) END"
    w = f"OVER ({code} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if x.op in ("corr", "cov"):
        u, v = f"CASE WHEN {a[1]} IS NOT NULL THEN {a[0]} END", f"CASE WHEN {a[0]} IS NOT NULL THEN {a[1]} END"
        if n == 1:
            return "CAST(NULL AS DOUBLE)"
        cov = f"covar_samp({u}, {v}) {w}"
        if x.op == "cov":
            return f"CASE WHEN count({u}) {w} = {n} THEN round({cov}, {DIGITS}) END"
        spread = f"(stddev_samp({u}) {w} * stddev_samp({v}) {w})"
        return f"CASE WHEN count({u}) {w} = {n} AND {spread} > 1e-12 THEN round({cov} / {spread}, {DIGITS}) END"
    if x.op == "half_mean":
        return f"CASE WHEN count({a[0]}) {w} >= {n // 2} THEN round(avg({a[0]}) {w}, {DIGITS}) END"
    held = f"list({a[0]}) {w}"
    out = {
        "min": f"min({a[0]}) {w}", "max": f"max({a[0]}) {w}", "sum": f"round(sum({a[0]}) {w}, {DIGITS})", "mean": f"round(avg({a[0]}) {w}, {DIGITS})",
        "std": f"round(stddev_samp({a[0]}) {w}, {DIGITS})", "product": f"round(list_aggregate({held}, 'product'), {DIGITS})",
        "argmax": f"CAST(list_position({held}, list_max({held})) AS DOUBLE)", "argmin": f"CAST(list_position({held}, list_min({held})) AS DOUBLE)",
        "ts_rank": f"(len(list_filter({held}, lambda v: v < {a[0]})) + (len(list_filter({held}, lambda v: v = {a[0]})) + 1) / 2.0) / {float(n)!r}",
        "decay": "round((" + " + ".join(f"{f'lag({a[0]}, {k}) OVER ({code})' if k else a[0]} * {float(n - k)!r}" for k in range(n)) + f") / {n * (n + 1) / 2.0!r}, {DIGITS})",
    }[x.op]
    return f"CASE WHEN count({a[0]}) {w} = {n} THEN {out} END"


def formula_sql(panel_sql: str, formula: X, result: str) -> str:
    """SQL for the same rows. panel_sql: a list of common table expressions that ends in one named `panel`.
    result: the final projection, in which {factor} stands for the value."""
    named: dict[str, str] = {}
    ctes, last = [panel_sql], "panel"
    for i, level in enumerate(_levels(formula)):
        inputs, operands = {}, {}
        for x in level:
            operands[x.key] = []
            for y in x.args:
                if y.key in named or y.op == "col":
                    operands[x.key].append(named.get(y.key, y.par))
                    continue
                if y.key not in inputs:
                    inputs[y.key] = (f"v{len(named) + len(inputs)}", _sql(y, named))
                operands[x.key].append(inputs[y.key][0])
        if inputs:
            ctes.append(f"i{i} AS (SELECT *, " + ", ".join(f"{s} AS {k}" for k, s in inputs.values()) + f" FROM {last})")
            last = f"i{i}"
            named |= {k: v[0] for k, v in inputs.items()}
        new = {x.key: (f"v{len(named) + j}", _sql_windowed(x, operands[x.key])) for j, x in enumerate(level)}
        ctes.append(f"w{i} AS (SELECT *, " + ", ".join(f"{s} AS {k}" for k, s in new.values()) + f" FROM {last})")
        last = f"w{i}"
        named |= {k: v[0] for k, v in new.items()}
    return "WITH " + ",\n".join(ctes) + "\nSELECT " + result.format(factor=_sql(formula, named)) + f" FROM {last}"
