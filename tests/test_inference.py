"""Tail probabilities, regressions and bootstrap tests against numerical integration, numpy and loops with the same draws."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions.distributions import f_p_value, t_p_value
from panelyard.operators import backtest, bootstrap, regression, series, smoothing, timing


def integral(f, a, b, n=100_000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (b - a) / n / 3


def t_p(t, n):
    f = lambda x: np.abs(np.cos(x)) ** (n - 1)
    return integral(f, np.arctan(abs(t) / np.sqrt(n)), np.pi / 2) / integral(f, 0, np.pi / 2)


def test_tails(spark):
    rows = [(float(t), float(n)) for t in (0, 0.01, 0.7, -1.4, 1.73, 1.8, 2.5, -5, 20) for n in (1, 2, 5, 30, 200, 9999, 100_000)]
    for r in spark.createDataFrame(rows, "t double, n double").select("t", "n", t_p_value(F.col("t"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(t_p(r.t, r.n), rel=1e-8, abs=1e-14)
    table = spark.createDataFrame([(12.706204736, 1.0), (2.228138852, 10.0), (2.042272456, 30.0)], "t double, n double")
    assert [r.p for r in table.select(t_p_value(F.col("t"), F.col("n")).alias("p")).collect()] == pytest.approx([0.05] * 3, abs=1e-9)
    rows = [(float(v), float(m), float(n)) for v in (0.01, 1, 2.5, 10) for m in (1, 2, 7) for n in (2, 20, 1000)]
    for r in spark.createDataFrame(rows, "v double, m double, n double").select("*", f_p_value(F.col("v"), F.col("m"), F.col("n")).alias("p")).collect():
        f = lambda x, r=r: np.abs(np.sin(x)) ** (r.n - 1) * np.abs(np.cos(x)) ** (r.m - 1)
        assert r.p == pytest.approx(integral(f, 0, np.arcsin(np.sqrt(r.n / (r.n + r.m * r.v)))) / integral(f, 0, np.pi / 2), rel=1e-7, abs=1e-13)
    none = spark.createDataFrame([(1.0, 0.0), (None, 5.0)], "t double, n double").select(t_p_value(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r.p for r in none] == [None, None]


def fit(y, x):
    a = np.c_[np.ones(len(y)), x]
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    left = y - a @ beta
    s2 = left @ left / (len(y) - a.shape[1])
    return beta, beta / np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a))), left


def test_several_regressors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(5):
        x = rng.normal(size=(40, 4)) * [1, 1e3, 1e-3, 1] + [0, 1e6, 0, 5]
        y = x @ [1, 1e-3, 200, -2] + g + rng.normal(size=40)
        rows += [(g, float(a), *map(float, b)) for a, b in zip(y, x)]
    rows += [(9, 1.0, 1.0, 2.0, 0.0, 1.0)] * 30 + [(8, float(k), float(k), float(2 * k), float(k * k), 1.0) for k in range(30)] + [(7, 1.0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, y double, a double, b double, c double, d double").repartition(4)
    xs = ["a", "b", "c", "d"]
    got = {r.g: r for r in regression.ols(df, "y", xs, ["g"]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]  # constant and dependent regressors have no fit
    for g in got:
        part = np.array([r[1:] for r in rows if r[0] == g])
        beta, t, left = fit(part[:, 0], part[:, 1:])
        assert got[g].beta == pytest.approx(beta, rel=1e-5) and got[g].t == pytest.approx(t, rel=1e-5)
        assert got[g].r2 == pytest.approx(1 - left @ left / ((part[:, 0] - part[:, 0].mean()) ** 2).sum())
    rest = regression.residuals(df.where("g = 1"), regression.ols(df, "y", xs, ["g"]), "y", xs, ["g"])
    assert rest.agg(F.abs(F.sum("residual"))).first()[0] < 1e-6


def t_of(y, x):
    return fit(y, x[:, None])[1][1]


def draw(seed, rows, *of):
    return int(hashlib.md5(":".join(map(str, (seed, *of))).encode()).hexdigest()[:8], 16) % rows


def largest(y, x, replicates, seed):
    n = len(y)
    picks = [[draw(seed, n, r, k) for k in range(n)] for r in range(replicates)]
    return np.array([abs(max(t_of(y[p], x[p][:, j]) for j in range(x.shape[1]))) for p in picks])


def test_incremental_with_the_same_draws(spark):
    rng = np.random.default_rng(7)
    n, replicates, seed = 110, 30, 3
    x = rng.normal(size=(n, 4))
    y = -3 * x[:, 0] + 0.9 * x[:, 1] + rng.normal(size=n)
    df = spark.createDataFrame([(k, float(y[k]), *map(float, x[k])) for k in range(n)], "date int, y double, a double, b double, c double, d double")
    got = [tuple(r) for r in bootstrap.incremental_test(df, "y", ["a", "b", "c", "d"], replicates, seed).collect()]
    want, left, now, number = [], [0, 1, 2, 3], y.copy(), 1
    while True:
        m = largest(now, x[:, left], replicates, seed)
        ts = {j: abs(t_of(now, x[:, j])) for j in left}
        ps = {j: float(np.mean(m >= ts[j])) for j in left}
        want += [(number, "abcd"[j], ts[j], ps[j], ps[j] < 0.1) for j in left]
        won = [j for j in left if ps[j] < 0.1]
        if not won or len(won) == len(left):
            break
        for j in won:
            now = fit(now, x[:, [j]])[2]
        left, number = [j for j in left if j not in won], number + 1
    assert number > 1 and [(*g[:2], g[4]) for g in got] == [(*w[:2], w[4]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6) and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert bootstrap.incremental_test(df.where("date < 90"), "y", ["a"], 5).count() == 0


def test_alpha_with_the_same_draws(spark):
    rng = np.random.default_rng(8)
    replicates, seed, rows = 25, 4, []
    for g in range(3):
        x = rng.normal(size=(45, 3))
        rows += [(g, k, float(v), *map(float, x[k])) for k, v in enumerate(x @ [1, -1, 0.5] + 0.1 * g + rng.normal(size=45))]
    df = spark.createDataFrame(rows, "g int, date int, y double, a double, b double, c double").repartition(3)
    for r in bootstrap.alpha_test(df, "y", ["a", "b", "c"], ["g"], replicates, seed).collect():
        part = np.array([v[2:] for v in rows if v[0] == r.g])
        y, x = part[:, 0], part[:, 1:]
        beta, t, left = fit(y, x)
        fake = y - beta[0]
        picks = [[draw(seed, len(y), k, j) for j in range(len(y))] for k in range(replicates)]
        pdf = [abs(fit(fake[p], x[p])[1][0]) for p in picks]
        assert r.alpha == pytest.approx(beta[0]) and r.alpha_t == pytest.approx(t[0]) and r.alpha_p == pytest.approx(np.mean(np.array(pdf) >= abs(t[0])))


def test_level_free_factors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 2)) + 3
    df = spark.createDataFrame([(k, *map(float, x[k])) for k in range(50)], "date int, a double, b double")
    assert bootstrap.orthogonalized(df, ["a"]).agg(F.avg("a")).first()[0] == pytest.approx(0, abs=1e-12)
    level = fit(x[:, 0], x[:, [1]])[0][0]
    assert bootstrap.orthogonalized(df, ["a"], ["b"]).orderBy("date").first().a == pytest.approx(x[0, 0] - level)


def test_exponential_mean_of_long_histories(spark):
    """Long enough to overflow a plain sum of decayed values, with gaps at the start, single and long ones."""
    rng = np.random.default_rng(3)
    x = [None, None] + [None if rng.random() < 0.2 or 900 < k < 1500 else float(rng.normal() + 5) for k in range(4000)]
    df = spark.createDataFrame([(c, k, v) for c in (1, 2) for k, v in enumerate(x)], "code int, date int, x double").repartition(4)
    for alpha in (0.01, 1 / 3, 0.9):
        got = {(r.code, r.date): r.m for r in smoothing.exponential_mean(df, "x", alpha, "m").collect()}
        mean, weight = None, 1.0
        for k, v in enumerate(x):
            weight *= 1 - alpha
            if v is not None:
                mean, weight = (v if mean is None else (weight * mean + alpha * v) / (weight + alpha)), 1.0
            assert got[1, k] == got[2, k] and (got[1, k] is None) == (mean is None)
            assert mean is None or got[1, k] == pytest.approx(mean, rel=1e-9)


def test_small_parts(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([5],), ([],)], "v array<int>")
    assert [r.q for r in df.select(timing.array_quantile(F.col("v"), 0.75).alias("q")).collect()] == [2.5, 5.0, None]
    nav = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 2.0, 1.0, 1.5, 3.0, 0.3])], "code string, date int, nav double")
    assert [r.rolling_drawdown for r in series.rolling_drawdown(nav, 3).orderBy("date").collect()] == pytest.approx([None, None, -0.5, -0.5, 0.0, -0.9])
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "z", 0.5)], "date int, code string, weight double")
    prices = spark.createDataFrame([(1, "a")], "date int, code string")
    kept, absent = backtest.missing_prices(weights, prices)
    assert {r.code: r.weight for r in kept.collect()} == {"a": 0.5, "z": 0.0} and [r.code for r in absent.collect()] == ["z"]
    with pytest.raises(ValueError, match="no price on 1 dates"):
        backtest.missing_prices(weights.withColumn("date", F.lit(2)), prices)


def test_draws_are_not_joined(spark):
    """A fund's draws are taken where its rows lie: what is drawn meets no other table."""
    df = spark.range(80).selectExpr("id % 2 AS g", "id AS date", "rand(1) AS y", "rand(2) AS a")
    found = bootstrap.alpha_test(df, "y", ["a"], ["g"], 5, 1)
    assert found.count() == 2 and found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
