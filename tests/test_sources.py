"""Loads by shape, history upkeep and sinks, on small tables written to a temporary folder."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from panelyard.operators import quality, selection
from panelyard.operators.asof import intervals_of
from panelyard.sources import access, history, ingest, loads, panel, sinks


def test_headers():
    said = loads.header("  roe [20230331 report] ttm [currency] percent ")
    assert said["metric"] == "roe" and said["kind"] == "ttm" and said["unit"] == "percent" and said["note"] == "20230331 report" and said["unit_note"] == "currency" and said["day"] == "2023-03-31"
    assert loads.header("close")["day"] is None and loads.header("x 20231399")["day"] is None and loads.header("[only note]")["metric"] == "[only note]"
    assert loads.shape(["Datetime", "code", "NAME", "metric", "value", "more"]) == "long" and loads.shape(["Code", "name", "DATE", "pe"]) == "daily" and loads.shape(["code", "name", "pe [20200101]"]) == "header"


def test_header_load(spark):
    rows = [("a", "A", "1.5", "n/a"), ("b", None, "x", "2"), (None, None, None, None), ("Source: somewhere", None, None, None)]
    df = spark.createDataFrame(rows, "Symbol string, Name string, `pe [20200131] lyr` string, `pb` string")
    got = {(r.code, r.metric): (str(r.datetime), r.value, r.remark) for r in loads.by_headers(df, footers=("source",)).collect()}
    assert got["a", "pe"] == ("2020-01-31 15:00:01", 1.5, {"header": "pe [20200131] lyr", "note": "20200131", "kind": "lyr"})
    assert got["b", "pe"][1] is None and got["b", "pb"][:2] == ("None", 2.0) and got["a", "pb"][1] is None and len(got) == 4
    dated = df.withColumn("day", F.when(F.col("Symbol") == "a", F.to_date(F.lit("2021-05-05"))))
    by_file = {(r.code, r.metric): str(r.datetime) for r in loads.by_headers(dated, file_day="day", footers=("source",)).collect()}
    assert by_file == {("a", "pe"): "2021-05-05 15:00:01", ("a", "pb"): "2021-05-05 15:00:01", ("b", "pe"): "2020-01-31 15:00:01", ("b", "pb"): "None"}


def test_day_of_a_file(spark, tmp_path):
    (tmp_path / "export_20220707.csv").write_text("code,name,pe ttm\na,A,3\n")
    (tmp_path / "export_20220808.csv").write_text("code,name,pe ttm\na,A,4\n")
    df = ingest.read_csv(spark, f"{tmp_path}/export_*.csv").select("*", loads.path_day(F.col("_metadata.file_path")).alias("day"))
    assert sorted((str(r.datetime), r.metric, r.value) for r in loads.by_headers(df, file_day="day").collect()) == [("2022-07-07 15:00:01", "pe", 3.0), ("2022-08-08 15:00:01", "pe", 4.0)]


def test_rejects(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{broken}"), (3, "text"), (4, None)], "k int, remark string")
    good, bad = loads.judged_remarks(df)
    assert sorted(r.k for r in good.collect()) == [1, 3, 4] and [(r.k, r.reason) for r in bad.collect()] == [(2, "remark: no JSON object")]
    days = spark.createDataFrame([("2020-02-29",), ("2021-02-29",), (" ",), (None,), ("soon",)], "d string")
    good, bad = loads.judged_days(days, "d")
    assert [str(r.d) for r in good.collect()] == ["2020-02-29"] and sorted(r.d for r in bad.collect()) == ["2021-02-29", "soon"]


def test_loads_in_any_order(spark):
    """Late, repeated and conflicting loads lead to one history, whatever their order; untouched keys keep their intervals."""
    staged = [
        spark.createDataFrame(rows, "code string, datetime int, value string, load int")
        for rows in ([("a", 1, "A", 0), ("a", 6, "A", 0), ("b", 2, "X", 0)], [("a", 5, "B", 1), ("a", 1, None, 1), ("a", 7, "A", 1)], [("a", 6, "C", 2), ("b", 2, "Y", 2), (None, 3, "Z", 2)])
    ]
    want = None
    for order in itertools.permutations([0, 1, 2]):
        points, intervals = staged[0].limit(0), intervals_of(staged[0].limit(0))
        for k in (*order, order[0]):
            points = history.merged(points, staged[k])
            intervals = history.refreshed(intervals, points, staged[k])
        got = sorted((r.code, r.value, r.valid_from, r.valid_to) for r in intervals.collect())
        want = want or got
        assert got == want
    assert want == [("a", "A", 1, 5), ("a", "A", 7, None), ("a", "B", 5, 6), ("a", "C", 6, 7), ("b", "Y", 2, None)]
    assert {r.code: r.value for r in history.latest(points).collect()} == {"a": "A", "b": "Y"}


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([(c, m, float(c * m)) for c in range(5) for m in range(1, 4)], "code int, m int, v double")
    files = lambda: {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    sinks.write_changed(spark, df, path, ["code"], F.col("m"), "month", first=True)
    before = files()
    changed = df.withColumn("v", F.when((F.col("m") == 2) & (F.col("code") == 3), -1.0).otherwise(F.col("v")))
    assert [r.month for r in sinks.write_changed(spark, changed, path, ["code"], F.col("m"), "month").collect()] == [2]
    after = files()
    assert {f.split("/")[-2] for f in before ^ after} == {"month=2"}
    assert sinks.write_changed(spark, changed, path, ["code"], F.col("m"), "month").count() == 0 and files() == after
    assert sorted(map(tuple, spark.read.parquet(path).select("code", "m", "v").collect())) == sorted(map(tuple, changed.collect()))
    sinks.write_table(df, str(tmp_path / "out"), ["code", "m"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 15


def test_facts_and_bounds(spark):
    long = spark.createDataFrame([("a", "open", 1.0), ("a", "open", 2.0), ("a", "pe", 3.0), ("b", "close", None)], "code string, metric string, value double")
    facts, rest = history.facts_and_rest(long, ["open", "close"], ["code"])
    assert sorted(map(tuple, facts.collect())) == [("a", 2.0, None), ("b", None, None)] and [r.metric for r in rest.collect()] == ["pe"]
    days = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-01-05')) AS date")
    assert access.known_within(days, "2020-01-02", "2020-01-04", "close").count() == 3
    assert access.known_within(days, "2020-01-02 15:00:02", "2020-01-04 15:00:00", "close").count() == 1
    with pytest.raises(ValueError):
        ingest.mapped(days, {"nothing": "x"})


def test_dataset_rules(spark):
    schema = "datetime timestamp, code string, metric string, value double, remark map<string,string>"
    row = lambda d, code, metric, value, remark=None: spark.createDataFrame([(None, code, metric, value, remark)], schema).withColumn("datetime", F.to_timestamp(F.lit(d)))
    reasons = lambda df, kind: sorted(r.reason for r in loads.judged_rows(df, kind)[1].collect())
    assert reasons(row("2020-01-01", "a", "x", 1.0, {"ind_name": "n", "ind_code": "c"}), "industry") == [] and reasons(row("2020-01-01", "a", "x", 1.0, {"ind_name": " "}), "industry") == ["industry code missing", "industry name missing"]
    assert reasons(row("2020-01-01", "a", "universe", 2.0, {"constituents": '["x", "y", "x"]'}), "index_universe") == []
    assert reasons(row("2020-01-01", "a", "universe", 3.0, {"constituents": '["x", "y", "x"]'}), "index_universe") == ["value is not the number of different constituents"]
    assert reasons(row("2020-01-01", "a", None, 3.0, {}), "index_universe") == ["metric", "no list of constituents"]
    assert reasons(row("2020-01-01", "SSE", loads.METRICS["trade_calendar"], 1.0), "trade_calendar") == [] and len(reasons(row("2020-01-01 10:00:00", " sse", "x", None), "trade_calendar")) == 4
    with pytest.raises(ValueError):
        loads.broken_rules("other")


def test_texts_and_json(spark):
    df = spark.createDataFrame([("fund (20180711-20250101)",), ("fund(1-2)",), (None,), ("f(20181399-20200101)",)], "t string")
    assert [(r.s.name, str(r.s.first), str(r.s.last)) for r in df.select(loads.name_span(F.col("t")).alias("s")).collect()] == [("fund", "2018-07-11", "2025-01-01"), ("fund(1-2)", "None", "None"), (None, "None", "None"), ("f", "None", "2020-01-01")]
    events = spark.createDataFrame([("2020-01-01 10:00:00.7", "1", "a"), ("2020-01-02", "0", "b"), ("soon", "1", "c"), ("2020-01-03", " 1.0", None)], "date string, event string, remark string")
    good, bad = loads.event_rows(events)
    assert sorted((str(r.time), r.remark) for r in good.collect()) == [("2020-01-01 10:00:00", "a"), ("2020-01-03 00:00:00", None)] and [r.text for r in bad.collect()] == ["soon"]
    rows = spark.createDataFrame([("k", 2, "b", 1.5), ("k", 1, "a", None)], "key string, n int, f string, v double")
    assert loads.json_rows(rows, ["key"], ["n"], ["f", "v"]).first().rows == '[{"f":"a"},{"f":"b","v":1.5}]' and loads.json_object(rows, ["key"], "f", "n").first().fields == '{"a":1,"b":2}'


def test_validated_and_searched(spark):
    df = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", " 2020-01-01", 1.0), ("a", "2020-01-02", None), ("a", "never", 2.0)], "code string, date string, v double")
    fixed, report = quality.validated(df, ["code"], "date", {"v": "ffill"})
    assert [(str(r.date), r.v) for r in fixed.collect()] == [("2020-01-01 00:00:00", 1.0), ("2020-01-02 00:00:00", 1.0)]
    assert {(r.check, r.column): r.rows for r in report.collect()} == {("missing", "v"): 1, ("not a time", "date"): 1, ("repeated", "date"): 1}
    with pytest.raises(ValueError, match="v is missing in 1 rows"):
        quality.validated(df, ["code"], "date", {"v": "raise"})
    assert selection.candidate_values("window", 5) == [3, 5, 10] and selection.candidate_values("window", 1.4) == [1, 1.4, 2.8] and selection.candidate_values("weight", 0.8) == [0.4, 0.8, 1.0]
    assert selection.candidate_values("threshold", 0.02) == pytest.approx([-0.03, 0.02, 0.07]) and selection.candidate_values("name", 7) == [7] and selection.candidate_values("exponent", 2.0) == [1.0, 2.0, 4.0]
    space = selection.search_space({"a": ("window", 4), "b": ("other", 1), "c": ("lag", 1), "d": ("weight", 0.5), "e": ("threshold", 0.1)})
    assert space["a"] == [2, 4, 8] and space["b"] == [1] and space["c"] == [1, 2] and len(space["d"]) == 3 and space["e"] == [0.1]
    assert selection.grid(spark, {k: [float(v) for v in vs] for k, vs in space.items()}).count() == 18


@pytest.mark.parametrize("turned", [False, True])
def test_lines_of_one_place(spark, turned):
    """Lines of one time, order and number: the smallest supplier's is first and last, wherever the lines lie."""
    rows = [(1, 1, k, 1.0, float(p)) for k, p in ((5, 50), (3, 30), (9, 90), (3, 20))]
    lines = spark.createDataFrame(rows[::-1] if turned else rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double")
    lines = lines.coalesce(1).withColumns({"l_shipdate": F.to_timestamp(F.lit("2020-01-06")), "nation": F.lit(4)})
    bar = panel.bars(lines, "nation", "week").first()
    assert (bar.open, bar.close, bar.high, bar.low) == (20.0, 20.0, 90.0, 20.0)


def test_tasks_by_rows(spark, monkeypatch):
    """A table is dealt over as many tasks as its rows ask for, and what is grouped by its keys isn't dealt again."""
    monkeypatch.setattr(panel, "ROWS_A_TASK", 10)
    df = panel.spread(spark.range(95).withColumn("k", F.col("id") % 40), 95, "k")
    assert df.rdd.getNumPartitions() == 10 and df.groupBy("k").count().rdd.getNumPartitions() == 10
    stored = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    missing = access.missing_keys(spark.range(4).withColumnRenamed("id", "k"), stored, ["k"])
    plan = missing._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.k for r in missing.collect()) == [0, 3] and plan.count("Aggregate") == 2  # keys meet once, not once a row
