"""Formulas against plain loops that were written from the published text, on a small panel where every branch runs."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import catalog
from panelyard.functions import formula as fm
from panelyard.functions.formula import with_formula
from panelyard.plans.formulas import rounded, rounded_sql

N, BARS = 5, 90


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(12)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, (N, BARS)), axis=1))
    open_ = close * (1 + rng.normal(0, 0.01, (N, BARS)))
    volume = rng.integers(500, 2000, (N, BARS)).astype(float)
    volume[:, ::7] *= 3
    return {
        "open": open_, "close": close, "high": np.maximum(open_, close) * (1 + rng.random((N, BARS)) * 0.02), "low": np.minimum(open_, close) * (1 - rng.random((N, BARS)) * 0.02),
        "volume": volume, "amount": volume * close, "vwap": (open_ + close) / 2, "returns": np.c_[np.full(N, np.nan), close[:, 1:] / close[:, :-1] - 1],
    }


@pytest.fixture(scope="module")
def panel(spark, bars):
    rows = [(c, t, *(None if math.isnan(v[c, t]) else float(v[c, t]) for v in bars.values())) for c in range(N) for t in range(BARS)]
    return spark.createDataFrame(rows, "code int, date int, " + ", ".join(f"{k} double" for k in bars)).repartition(3).cache()


def rank(x):
    """By date, ties averaged, over the number of values."""
    out = np.full_like(x, np.nan)
    for t in range(x.shape[1]):
        v = x[:, t]
        for c in np.flatnonzero(~np.isnan(v)):
            out[c, t] = ((v < v[c]).sum() + ((v == v[c]).sum() + 1) / 2) / (~np.isnan(v)).sum()
    return out


def rolling(x, n, f):
    out = np.full_like(x, np.nan)
    for c in range(x.shape[0]):
        for t in range(n - 1, x.shape[1]):
            w = x[c, t - n + 1 : t + 1]
            if not np.isnan(w).any():
                out[c, t] = f(w)
    return out


def two(x, y, n, f, least=1e-12):
    out = np.full_like(x, np.nan)
    for c in range(x.shape[0]):
        for t in range(n - 1, x.shape[1]):
            a, b = x[c, t - n + 1 : t + 1], y[c, t - n + 1 : t + 1]
            if not (np.isnan(a).any() or np.isnan(b).any()) and a.std() * b.std() > least:
                out[c, t] = f(a, b)
    return out


def delay(x, n):
    return np.c_[np.full((x.shape[0], n), np.nan), x[:, :-n]]


def delta(x, n):
    return x - delay(x, n)


def corr(x, y, n):
    return two(x, y, n, lambda a, b: np.corrcoef(a, b)[0, 1])


def mean(x, n):
    return rolling(x, n, np.mean)


def ts_rank(x, n):
    return rolling(x, n, lambda w: ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / n)


def f1(b):
    base = np.where(b["returns"] < 0, rolling(b["returns"], 20, lambda w: w.std(ddof=1)), b["close"])
    return rank(rolling(np.sign(base) * np.abs(base) ** 2, 5, lambda w: w.argmax() + 1.0)) - 0.5


def f7(b):
    busy = mean(b["amount"], 20) < b["volume"]
    d = delta(b["close"], 7)
    return np.where(busy, -ts_rank(np.abs(d), 60) * np.sign(d), -1.0)


def f12(b):
    return np.sign(delta(b["volume"], 1)) * -delta(b["close"], 1)


def f21(b):
    eight, two_, spread = mean(b["close"], 8), mean(b["close"], 2), rolling(b["close"], 8, lambda w: w.std(ddof=1))
    with np.errstate(invalid="ignore"):
        busy = np.where(1 <= b["volume"] / mean(b["amount"], 20), 1.0, -1.0)
        return np.where(eight + spread < two_, -1.0, np.where(two_ < eight - spread, 1.0, busy))


WANT = {
    1: f1, 2: lambda b: -corr(rank(delta(np.log(b["volume"]), 2)), rank((b["close"] - b["open"]) / b["open"]), 6), 3: lambda b: -corr(rank(b["open"]), rank(b["volume"]), 10), 4: lambda b: -ts_rank(rank(b["low"]), 9),
    6: lambda b: -corr(b["open"], b["volume"], 10), 7: f7, 9: lambda b: (lambda d: np.where(rolling(d, 5, np.min) > 0, d, np.where(rolling(d, 5, np.max) < 0, d, -d)))(delta(b["close"], 1)), 12: f12,
    13: lambda b: -rank(np.round(two(rank(b["close"]), rank(b["volume"]), 5, lambda a, c: np.cov(a, c)[0, 1], -1), 10)), 21: f21, 26: lambda b: -rolling(corr(ts_rank(b["volume"], 5), ts_rank(b["high"], 5), 5), 3, np.max),
    33: lambda b: rank(-(1 - b["open"] / b["close"])), 41: lambda b: np.sqrt(b["high"] * b["low"]) - b["vwap"], 44: lambda b: -corr(b["high"], rank(b["volume"]), 5), 53: lambda b: -delta(((b["close"] - b["low"]) - (b["high"] - b["close"])) / (b["close"] - b["low"]), 9),
    54: lambda b: -((b["low"] - b["close"]) * b["open"] ** 5) / ((b["low"] - b["high"]) * b["close"] ** 5), 101: lambda b: (b["close"] - b["open"]) / (b["high"] - b["low"] + 0.001),
}


@pytest.mark.parametrize("number", sorted(WANT))
def test_against_loops(panel, bars, number):
    """adv here is the mean amount; so that volume is above it at times, formulas 7 and 21 get amounts of volume's size."""
    b, df = bars, panel
    if number in (7, 21):
        b = bars | {"amount": bars["volume"] * 1.05}
        df = panel.withColumn("amount", panel.volume * 1.05)
    got = np.full((N, BARS), np.nan)
    for r in with_formula(df, catalog.FORMULAS[number]).collect():
        got[r.code, r.date] = np.nan if r.factor is None else r.factor
    want = WANT[number](b)
    late = slice(70, None)  # all windows are full
    assert not np.isnan(got[:, late]).all()
    np.testing.assert_allclose(got[:, late], want[:, late], rtol=1e-6, atol=1e-8)
    if number in (7, 21):
        assert len(np.unique(np.round(got[:, late], 6))) > (2 if number == 7 else 1) and (got[:, late] == -1).any() and (got[:, late] != -1).any()


@pytest.mark.parametrize("of", [fm.correlation, fm.covariance])
def test_two_bars_that_hardly_differ(spark, of):
    """Both engines round what two large and close values leave of their means alike, so its ranks are the same."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(c, t, 2e5 + rng.random() / 500, 1e5 + rng.random() / 500) for c in range(40) for t in range(6)], columns=["code", "date", "a", "b"])
    formula = fm.rank(of(fm.col("a"), fm.col("b"), 2))
    got = {(r.code, r.date): r.factor for r in with_formula(spark.createDataFrame(rows), formula).collect()}
    want = duckdb.connect().execute(fm.formula_sql("panel AS (SELECT * FROM rows)", formula, "code, date, {factor}")).fetchall()
    assert len({v for _, _, v in want}) > 40 and got == {(c, t): v for c, t, v in want}


def test_power_of_varying_exponents(spark):
    """The SQL engine's power to the last digit, which decides how a large value is rounded; missing, zero and endless values."""
    draw = random.Random(5)
    pairs = [(draw.randrange(1, 43) / 42, draw.uniform(-2e4, 2e4) ** 3 / 1e10) for _ in range(4000)]
    pairs += [(20 / 21, -394.38589473684215), (-0.5, 3.5), (0.0, 2.0), (0.0, 0.0), (None, 2.0), (0.5, None), (0.5, -1e5), (0.5, 1e5), (1.0, 7.0)]
    frame = spark.createDataFrame([(i, i, *p) for i, p in enumerate(pairs)], "code long, date int, x double, y double")
    formula = fm.signedpower(fm.col("x"), fm.col("y"))
    got = with_formula(frame, formula).withColumn("r", rounded(F.col("factor"))).orderBy("code").select("factor", "r").collect()
    con = duckdb.connect()
    con.execute("create table t (code bigint, x double, y double)")
    con.executemany("insert into t values (?, ?, ?)", [(i, *p) for i, p in enumerate(pairs)])
    want = con.execute(f"select z, {rounded_sql('z')} from (select code, sign(x) * pow(abs(x), y) as z from t) order by code").fetchall()
    assert [tuple(r) for r in got] == want
    assert got[4000].r == 227384403.41 and got[4006].factor == math.inf


def test_sums_of_prices_are_rounded_alike(spark):
    """Sums whose last digits lie near halves of the tenth digit, to the last digit of the SQL engine, with missing and negative ones."""
    rng = np.random.default_rng(11)
    rows = [(c, t, None if rng.random() < 0.01 else (c % 3 - 1) * 10.0 ** (c % 7) * float(np.round(rng.random() * 1e5, 2)) / (1 + t % 50)) for c in range(40) for t in range(60)]
    con = duckdb.connect()
    con.execute("create table panel_rows (code bigint, date bigint, a double)")
    con.executemany("insert into panel_rows values (?, ?, ?)", rows)
    for formula in (fm.ts_sum(fm.col("a"), 5), fm.ts_mean(fm.col("a"), 3), fm.decay_linear(fm.col("a"), 4)):
        got = {(r.code, r.date): r.factor for r in with_formula(spark.createDataFrame(rows, "code long, date long, a double"), formula).collect()}
        want = con.execute(fm.formula_sql("panel AS (SELECT * FROM panel_rows)", formula, "code, date, {factor}")).fetchall()
        assert got == {(c, t): v for c, t, v in want}


def test_large_results_are_rounded_alike(spark):
    """Values whose hundredfold a double rounds to a half."""
    values = [s * v for s in (1, -1) for v in (925577200.574963, 150466475.35496297, 700729954.944963, 706200067.574963, 566062310.554963, 161548620.26496297, 12345.67, 0.1234565, 0.0, 1e9, 1e300, math.inf)]
    got = [r.r for r in spark.createDataFrame(list(enumerate(values)), "i long, x double").orderBy("i").select(rounded(F.col("x")).alias("r")).collect()]
    con = duckdb.connect()
    con.execute("create table t (i bigint, x double)")
    con.executemany("insert into t values (?, ?)", list(enumerate(values)))
    assert got == [v for (v,) in con.execute(f"select {rounded_sql('x')} from t order by i").fetchall()]
