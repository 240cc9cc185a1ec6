"""Operators that SQL can't repeat, against plain loops: resampled tests and whole lots."""

import numpy as np
import pytest

from panelyard.operators import backtest, bootstrap, portfolio


def t_of(y, x):
    r = np.corrcoef(x, y)[0, 1]
    return r * np.sqrt(len(x) - 2) / np.sqrt(1 - r * r)


def test_largest_t_with_the_same_draws(spark):
    rng = np.random.default_rng(1)
    n, replicates, seed = 30, 40, 9
    x = {"a": rng.normal(size=n), "b": rng.normal(size=n)}
    y = 0.6 * x["a"] + rng.normal(size=n)
    rows = [(k, f, float(x[f][k]), float(y[k])) for k in range(n) for f in x]
    long = spark.createDataFrame(rows, "date int, factor string, x double, y double")
    got = {r.factor: r for r in bootstrap.max_t_test(long, replicates, seed).collect()}
    picks = {}
    for r in bootstrap.draws(n, spark.range(replicates).selectExpr("cast(id as int) as replicate"), seed).collect():
        picks.setdefault(r.replicate, []).append(r.place)
    largest = [abs(max(t_of(y[p], x[f][p]) for f in x)) for p in picks.values()]
    assert len(largest) == replicates and all(len(p) == n for p in picks.values())
    for f in x:
        t = t_of(y, x[f])
        assert got[f].t == pytest.approx(t) and got[f].p_value == pytest.approx(np.mean([m >= abs(t) for m in largest]))


def test_whole_lots_over_many_dates(spark):
    rng = np.random.default_rng(4)
    rows = [(p, d, c, float(w), float(rng.uniform(5, 50))) for p in ("u", "v") for d in range(7) for c, w in zip("abcd", rng.dirichlet(np.ones(4))) if rng.random() > 0.15]
    got = {(r.portfolio, r.date, r.code): (r.lots, r.wealth) for r in backtest.integer_lots(spark.createDataFrame(rows, "portfolio string, date int, code string, weight double, price double"), 1e6).collect()}
    want = {}
    for p in ("u", "v"):
        wealth, before = 1e6, {}
        for d in range(7):
            now = {c: (w, price) for q, e, c, w, price in rows if q == p and e == d}
            gain = sum(a * (now[c][1] / price - 1) for c, (a, price) in before.items() if c in now)
            wealth *= 1 + gain
            before = {}
            for c, (w, price) in now.items():
                lots = int(w * wealth / price / 100)
                want[p, d, c] = (lots, wealth)
                before[c] = (lots * 100 * price / wealth, price)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_trade_pairs_against_a_queue(spark):
    rng = np.random.default_rng(5)
    rows = [(c, "buy" if rng.random() < 0.5 else "sell", t) for c in range(5) for t in range(40)]
    got = sorted((r.code, r.bought, r.sold) for r in portfolio.trade_pairs(spark.createDataFrame(rows, "code int, side string, time int"), ["time"]).collect())
    want, waiting = [], {}
    for c, side, t in rows:
        if side == "buy":
            waiting.setdefault(c, []).append(t)
        elif waiting.get(c):
            want.append((c, waiting[c].pop(0), t))
    assert got == sorted(want)
