"""Operators on small frames, against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from panelyard.operators import asof, backtest, cross_section, quality, series, timing
from panelyard.sources import ingest


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_asof_ties_tolerance_and_gaps(spark):
    facts = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', 1.0), ('a', timestamp'2024-01-03 00:00:00', 3.0) t(code, datetime, value)")
    probes = spark.sql("select * from values ('a', timestamp'2024-01-03 00:00:00', 7), ('a', timestamp'2024-01-02 12:00:00', 8), ('b', timestamp'2024-01-02 00:00:00', 9) t(code, input_ts, tag)")
    before = {r.tag: (r.value, r.diff_hours) for r in asof.nearest(probes, facts).collect()}
    assert before == {7: (3.0, 0.0), 8: (1.0, 36.0), 9: (None, None)}
    after = {r.tag: r.value for r in asof.nearest(probes, facts, "after").collect()}
    assert after == {7: None, 8: 3.0, 9: None}
    assert {r.tag: r.value for r in asof.nearest(probes, facts, "before", 24).collect()} == {7: 3.0, 8: None, 9: None}
    assert asof.nearest(probes.limit(0), facts).count() == 0


def test_suspended_weights(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (1, "c", 0.25)], "date int, code string, weight double")
    status = spark.createDataFrame([(1, "a", 0)], "date int, code string, status int")
    assert [r.weight for r in backtest.suspended(w, status).orderBy("code").collect()] == [0.0, 0.25, 0.25]
    assert [r.weight for r in backtest.suspended(w, status, "redistribute").orderBy("code").collect()] == [0.0, 0.5, 0.5]
    with pytest.raises(ValueError):
        backtest.suspended(w, status, "?")


def test_integer_lots_against_a_loop(spark):
    data = [("p", 1, "a", 0.6, 10.0), ("p", 1, "b", 0.4, 7.0), ("p", 2, "a", 0.5, 12.0), ("p", 2, "b", 0.5, 6.0)]
    got = {(r.date, r.code): r for r in backtest.integer_lots(spark.createDataFrame(data, "portfolio string, date int, code string, weight double, price double"), 10_000.0, 100).collect()}
    assert (got[1, "a"].lots, got[1, "b"].lots) == (6, 5)
    wealth = 10_000 * (1 + 0.6 * 0.2 + 0.35 * (6 / 7 - 1))
    assert math.isclose(got[2, "a"].wealth, wealth) and got[2, "a"].lots == int(0.5 * wealth / 12 / 100)
    changed = backtest.trades(spark.createDataFrame([r.asDict() for r in got.values()])).orderBy("date", "code").collect()
    assert [(r.date, r.code, r.side) for r in changed][:2] == [(1, "a", "buy"), (1, "b", "buy")]


def test_fill_and_distinct(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 6.0), ("a", 5, None)], "code string, date int, x double")
    of = lambda how: [r.x for r in quality.fill(df, "x", how).orderBy("date").collect()]
    assert of("ffill") == [None, 2.0, 2.0, 6.0, 6.0] and of("bfill") == [2.0, 2.0, 6.0, 6.0, None]
    assert of("interpolate") == [None, 2.0, 4.0, 6.0, None] and of("mean") == [4.0, 2.0, 4.0, 6.0, 4.0] and of("drop") == [2.0, 6.0]
    dup = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, v string")
    assert rows(quality.strict_distinct(dup, ["k"], ["v"]), "k", "v") == [(1, "a"), (2, "a"), (2, "b")]


def test_rejected_rows(spark):
    df = spark.createDataFrame([("2024-01-02", "a", "open", "1.5"), ("bad", "", "open", "x"), ("2024-01-03", "a", "close", "N/A")], "datetime string, code string, metric string, value string")
    good, bad = ingest.parsed(df)
    assert [(r.code, r.value) for r in good.collect()] == [("a", 1.5)]
    assert sorted(r.reason for r in bad.collect()) == ["code: empty", "datetime: not a time", "value: not a finite number"]
    assert ingest.page(good, 5).count() == 1 and ingest.page(good, 5, ("2024-01-01", "a", "open")).count() == 0


def test_runs_and_drawdown(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 2.0, -1.0, 3.0, 4.0])], "code string, date int, x double")
    assert [r.run for r in timing.runs(df, F.col("x") > 0).orderBy("date").collect()] == [1, 1, None, 2, 2]
    nav = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 1.0)], "code string, date int, nav double")
    assert series.summary(nav).first().max_drawdown == -0.5


def test_quantiles_of_equal_values(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 2.0), (2, None)], "date int, x double")
    got = {(r.date, r.x): r.label for r in cross_section.quantile_label(df, "x", 2).collect()}
    assert got == {(1, 5.0): None, (2, 1.0): 0, (2, 2.0): 1, (2, None): None}
