"""Sweeps: series of candidates against plain loops, and what their steps do to the rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from panelyard.operators import sweep
from panelyard.sources.panel import panel

SF = "/root/testdata/sf0.001"
DATES = [dt.date(2020, m, 1) for m in range(1, 8)]
CANDIDATES = [(0, 0, 2), (1, 0, 4), (2, 1, 2), (3, 1, 4), (4, 1, 3)]


def made_rows():
    """Few values, so that edges and sides have ties; rows, returns and whole dates are missing."""
    draw = random.Random(4)
    rows = []
    for fid in (0, 1):
        for d in DATES:
            if (fid, d) == (1, DATES[3]):
                continue
            for code in range(12):
                if draw.random() < 0.75:
                    x = float(draw.randrange(3 if d == DATES[5] else 7)) if d != DATES[1] else 1.0
                    rows.append((code, d, fid, x, None if draw.random() < 0.1 else draw.uniform(-0.1, 0.1)))
    return rows


def edge(values, q):
    at = (len(values) - 1) * q
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] if values[low] == values[high] else values[low] + (at - low) * (values[high] - values[low])


def plain(rows):
    """(gid, date): return, turnover."""
    ahead = dict(zip(DATES, DATES[1:]))
    out = {}
    for gid, fid, n in CANDIDATES:
        weights = {}
        for d in DATES:
            own = [(c, x, f) for c, day, k, x, f in rows if day == d and k == fid]
            values = sorted(x for _, x, _ in own)
            edges = {edge(values, i / n) for i in range(n + 1)} if values else set()
            labels = {c: max(0, sum(e < x for e in edges) - 1) for c, x, _ in own} if len(edges) > 1 else {}
            low, top = min(labels.values(), default=0), max(labels.values(), default=0)
            sides = {c: 1 if v == top else -1 for c, v in labels.items() if low < top and v in (low, top)}
            weights[d] = {c: s / sum(o == s for o in sides.values()) for c, s in sides.items()}
            if d in ahead and sides:
                out.setdefault((gid, ahead[d]), [None, None])[0] = sum(weights[d][c] * (f or 0.0) for c, _, f in own if c in sides)
        for before, d in zip([None, *DATES], DATES):
            old, new = weights.get(before, {}), weights[d]
            if old or new:
                out.setdefault((gid, d), [None, None])[1] = sum(abs(new.get(c, 0) - old.get(c, 0)) for c in {*old, *new}) / 2
    return out


def made(spark):
    clean = spark.createDataFrame(made_rows(), "code long, date date, fid int, x double, forward double")
    calendar = spark.createDataFrame(list(zip(DATES, [*DATES[1:], None])), "date date, next date")
    return clean, calendar, sweep.series(sweep.portfolios(clean, [n for _, _, n in CANDIDATES]), CANDIDATES, calendar)


def test_series_of_candidates(spark):
    found = {(r.gid, r.date): (r.ret, r.turnover) for r in made(spark)[2].collect()}
    want = plain(made_rows())
    assert found.keys() == want.keys() and len(want) > 25
    for key, pair in want.items():
        assert found[key] == pytest.approx(pair, abs=1e-12), key


def test_rows_are_dealt_once_for_weights_and_once_for_their_changes(spark):
    """A row of weights is shuffled by factor and date, and by factor and code; what follows are sums by factor and date."""
    plan = made(spark)[2]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k#") == 1 and plan.count("hashpartitioning(fid#") == 2 and "gid#" in plan
    assert plan.count("Scan ExistingRDD") == 2  # the rows and the calendar


def test_bars_outside_give_no_rows(spark):
    bars = spark.createDataFrame([(1, d, 2.0**i, i != 2) for i, d in enumerate(DATES)], "code long, date date, p double, inside boolean")
    found = sweep.exposures(bars, {0: F.col("p"), 1: F.col("p") * 2}, "p", F.col("inside")).collect()
    assert sorted((r.date, r.fid, r.x, r.forward) for r in found if r.date < DATES[-1]) == [(d, k, 2.0**i * (k + 1), 1.0) for i, d in enumerate(DATES[:-1]) if i != 2 for k in (0, 1)]
    plan = sweep.exposures(bars, {0: F.col("p"), 1: F.col("p") * 2}, "p", F.col("inside"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode[\s\S]*\n[^\n]*Filter [^\n]*inside#", plan)  # rows are left out below the step that makes rows of variants


def test_narrow_panels_do_not_sort_lines(spark):
    narrow, wide = panel(spark, SF, only=("amount", "vwap")), panel(spark, SF)
    assert narrow.columns == ["code", "date", "amount", "vwap"]
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "s_suppkey" not in plan and "SortAggregate" in wide._jdf.queryExecution().executedPlan().toString()
    assert sorted(narrow.collect()) == sorted(wide.select("code", "date", "amount", "vwap").collect())
