"""Queries of loads by shape, of history upkeep and of sinks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import quality
from panelyard.plans.research import PANEL, R, neat
from panelyard.sources import history, ingest, loads, sinks
from panelyard.sources.panel import kept, load, panel, shared_folder, spread

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Headers of a made-up export: traded amounts and volumes of two years.
HEADERS = {"amount [19960131] sum [currency] usd": ("amount", 1996), "volume [1997] sum": ("volume", 1997), "amount [19980228 total] sum": ("amount", 1998)}


def _export(spark, sf_dir) -> DataFrame:
    """Suppliers by year as text cells under headers with metadata; cells without trade are N/A, and a footer follows."""
    bars = panel(spark, sf_dir)
    cell = lambda c, y: F.coalesce(F.round(F.sum(F.when(F.year("date") == y, F.col(c))), 2).cast("string"), F.lit("N/A"))
    wide = bars.groupBy("code").agg(*(cell(c, y).alias(h) for h, (c, y) in HEADERS.items())).join(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")), "code")
    rows = wide.select(F.col("code").cast("string").alias("Code"), F.col("name").alias("Name"), *(F.col(f"`{h}`") for h in HEADERS))
    return rows.unionByName(spark.range(1).select(F.lit("Source: export").alias("Code")), allowMissingColumns=True)


_EXPORT = f"""{PANEL}, yr AS (SELECT code, year(date) AS y, round(sum(amount), 2) AS amount, sum(volume) AS volume FROM panel GROUP BY 1, 2), sp AS (SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, s_suppkey AS k FROM supplier WHERE s_suppkey IN (SELECT code FROM panel)),
cells AS (SELECT sp.code, name, 'amount' AS metric, CAST('1996-01-31 15:00:01' AS TIMESTAMP) AS datetime, 'sum' AS kind, (SELECT amount FROM yr WHERE yr.code = k AND y = 1996) AS value FROM sp
UNION ALL SELECT sp.code, name, 'volume', NULL, 'sum', (SELECT volume FROM yr WHERE yr.code = k AND y = 1997) FROM sp UNION ALL SELECT sp.code, name, 'amount', CAST('1998-02-28 15:00:01' AS TIMESTAMP), 'sum', (SELECT amount FROM yr WHERE yr.code = k AND y = 1998) FROM sp)"""


@query(f"{_EXPORT} SELECT CAST(datetime AS VARCHAR) AS datetime, code, name, metric, kind, {R('value', 'value')} FROM cells")
def header_wide_load(spark, sf_dir):
    found = loads.by_headers(_export(spark, sf_dir), footers=("source:",))
    return neat(found.select(F.col("datetime").cast("string").alias("datetime"), "code", "name", "metric", F.col("remark")["kind"].alias("kind"), "value"), "datetime", "code", "name", "metric", "kind")


@query(f"""{_EXPORT}, d AS (SELECT CAST(CAST(date AS VARCHAR) || ' 15:00:01' AS TIMESTAMP) AS datetime, CAST(code AS VARCHAR) AS code, 'n' AS name, unnest(['close', 'volume']) AS metric, unnest([close, volume]) AS value FROM panel)
SELECT 'header' AS shape, metric, count(*) AS n, count(value) AS filled, {R('sum(value)', 'total')} FROM cells GROUP BY metric UNION ALL SELECT s, metric, count(*), count(value), {R('sum(value)', 'total')} FROM (SELECT unnest(['daily', 'long']) AS s, * FROM d WHERE value IS NOT NULL) GROUP BY s, metric""")
def load_by_shape(spark, sf_dir):
    """Three tables of different shapes, each recognised by its columns."""
    bars = panel(spark, sf_dir).select(F.col("date").alias("Date"), F.col("code").alias("Code"), F.lit("n").alias("Name"), "close", "volume")
    long = bars.unpivot(["Date", "Code", "Name"], ["close", "volume"], "Metric", "Value").withColumn("Datetime", F.col("Date").cast("timestamp")).where("Value IS NOT NULL")
    parts = {"header": loads.any_shape(_export(spark, sf_dir), footers=("source:",)), "daily": loads.any_shape(bars), "long": loads.any_shape(long.drop("Date"))}
    whole = None
    for kind, part in parts.items():
        told = part.groupBy("metric").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.sum("value").alias("total")).withColumn("shape", F.lit(kind))
        whole = told if whole is None else whole.unionByName(told)
    return neat(whole, "shape", "metric", "n", "filled")


def _observations(spark, sf_dir) -> DataFrame:
    """A supplier's order priority at each order date, and the load that brings it: months by threes, some of them NULL."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("code"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("datetime"), F.col("o_orderpriority").alias("p"), F.month("o_orderdate").alias("m"))
    rows = lines.count()
    both = spread(lines, rows, "l_orderkey").join(spread(orders, rows, "l_orderkey"), "l_orderkey")
    return spread(both, rows, "code").groupBy("code", "datetime").agg(F.max("p").alias("p"), F.max("m").alias("m")).select("code", "datetime", F.when(F.col("m") != 5, F.col("p")).alias("value"), (F.col("m") % 3).alias("load"))


@query("""WITH o AS (SELECT l_suppkey AS code, CAST(o_orderdate AS TIMESTAMP) AS datetime, max(o_orderpriority) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE month(o_orderdate) <> 5 GROUP BY 1, 2),
m AS (SELECT *, lag(value) OVER (PARTITION BY code ORDER BY datetime) AS b FROM o), c AS (SELECT * FROM m WHERE b IS NULL OR b <> value)
SELECT code, value, datetime AS valid_from, lead(datetime) OVER (PARTITION BY code ORDER BY datetime) AS valid_to FROM c""")
def history_upkeep(spark, sf_dir):
    """Three loads in no order of time, one of them twice; what stands is the history of all observations."""
    seen = kept(_observations(spark, sf_dir))
    points = intervals = None
    for number in (2, 0, 2, 1):
        staged = seen.where(F.col("load") == number)
        points = kept(history.merged(points if points is not None else staged.limit(0), staged))
        start = spark.createDataFrame([], "code bigint, value string, valid_from timestamp, valid_to timestamp").select(F.col("code").cast(seen.schema["code"].dataType).alias("code"), "value", "valid_from", "valid_to")
        intervals = history.refreshed(intervals if intervals is not None else start, points, staged)
    return intervals


@query(f"""{PANEL} SELECT code, date, {R("CASE WHEN month(date) % 2 = 0 THEN open ELSE open * 2 END", 'open')}, {R('CASE WHEN month(date) % 2 = 0 THEN close ELSE close * 2 END', 'close')} FROM panel WHERE open IS NOT NULL""")
def insert_only_load(spark, sf_dir):
    """A table with the even months' prices takes a load with all months': what is there stays, what isn't comes in."""
    long = panel(spark, sf_dir).select("code", "date", "open", "close", "volume").where("open IS NOT NULL").unpivot(["code", "date"], ["open", "close", "volume"], "metric", "value")
    stored, _ = history.facts_and_rest(long.where("month(date) % 2 = 0"), ["open", "close"], ["code", "date"])
    staged, _ = history.facts_and_rest(long.withColumn("value", F.col("value") * 2), ["open", "close"], ["code", "date"])
    return neat(ingest.upserted(stored, staged, ["code", "date"], insert_only=True), "code", "date")


@query(f"""{PANEL} SELECT code, date, year(date) AS year, {R('CASE WHEN year(date) = 1998 THEN close + 1 ELSE close END', 'close')} FROM panel""")
def changed_partitions(spark, sf_dir):
    """A table by years, written whole, then again with one changed year, of which only that year is written."""
    path = f"{shared_folder(spark)}/closes-{uuid.uuid4().hex}"
    bars = kept(panel(spark, sf_dir).select("code", "date", "close"))
    sinks.write_changed(spark, bars, path, ["code", "date"], F.year("date"), "year", first=True)
    again = bars.withColumn("close", F.when(F.year("date") == 1998, F.col("close") + 1).otherwise(F.col("close")))
    sinks.write_changed(spark, again, path, ["code", "date"], F.year("date"), "year")
    return neat(spark.read.parquet(path), "code", "date", "year")


@query(f"""{PANEL}, rw AS (SELECT code, date, CASE WHEN code % 7 = 0 THEN 'other' ELSE '交易状态' END AS metric, CASE WHEN volume IS NOT NULL THEN CAST((code + month(date)) % 3 AS DOUBLE) END AS value FROM panel)
SELECT code, 'metric' AS reason, count(*) AS n FROM rw WHERE metric <> '交易状态' GROUP BY 1, 2 UNION ALL SELECT code, 'value is neither 0 nor 1', count(*) FROM rw WHERE value IS NULL OR value = 2 GROUP BY 1, 2""")
def dataset_rule_rejects(spark, sf_dir):
    """Rows of trade status that the dataset's rules reject, by code and reason."""
    rows = panel(spark, sf_dir).select(
        "code", F.col("date").cast("timestamp").alias("datetime"), F.when(F.col("code") % 7 == 0, "other").otherwise("交易状态").alias("metric"),
        F.when(F.col("volume").isNotNull(), ((F.col("code") + F.month("date")) % 3).cast("double")).alias("value"), F.lit(None).cast("map<string,string>").alias("remark"),
    )
    return loads.judged_rows(rows, "trade_status")[1].groupBy("code", "reason").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('second', ts) AS time, event_type AS remark, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2")
def event_file_scan(spark, sf_dir):
    """Events as a table of texts with flags, read back: those that are marked, to the second."""
    text = load(spark, sf_dir, "events").select(F.date_format("ts", " yyyy-MM-dd HH:mm:ss.SSS").alias("date"), F.col("event_type").isin("purchase", "signup").cast("int").cast("string").alias("event"), F.col("event_type").alias("remark"))
    return loads.event_rows(text)[0].groupBy("time", "remark").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority AS name, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, o_custkey AS code FROM orders GROUP BY o_orderpriority, o_custkey""")
def name_spans(spark, sf_dir):
    """Names with their dates written into them, taken apart again."""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    text = F.concat("o_orderpriority", F.lit("("), F.date_format("a", "yyyyMMdd"), F.lit("-"), F.date_format("b", "yyyyMMdd"), F.lit(")"))
    return o.select(F.col("o_custkey").alias("code"), loads.name_span(text).alias("s")).select("code", "s.*")


@query(f"""{PANEL}, q AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY coalesce(amount, 0) DESC, code) AS ordinal FROM panel WHERE month(date) = 1), t AS (SELECT code, lower(CAST(month(date) AS VARCHAR)) AS field, count(volume) AS n FROM panel GROUP BY 1, 2)
SELECT CAST(date AS VARCHAR) AS key, CAST(to_json(list({{'ordinal': ordinal, 'code': code}} ORDER BY ordinal)) AS VARCHAR) AS json FROM q WHERE ordinal <= 20 GROUP BY date
UNION ALL SELECT CAST(code AS VARCHAR), CAST(to_json(map_from_entries(list((field, n) ORDER BY field))) AS VARCHAR) FROM t GROUP BY code""")
def json_aggregates(spark, sf_dir):
    """The twenty largest codes of each January as a JSON array, each code's bars by month as a JSON object."""
    bars = kept(panel(spark, sf_dir).select("code", "date", "amount", "volume"))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.coalesce("amount", F.lit(0.0)).desc(), "code"))
    ranked = bars.where(F.month("date") == 1).withColumn("ordinal", place).where("ordinal <= 20").withColumn("key", F.col("date").cast("string"))
    counts = bars.groupBy(F.col("code").cast("string").alias("key"), F.month("date").cast("string").alias("field")).agg(F.count("volume").alias("n"))
    return loads.json_rows(ranked, ["key"], ["ordinal"], ["ordinal", "code"], "json").unionByName(loads.json_object(counts, ["key"], "field", "n", "json"))


@query(f"""{PANEL}, s AS (SELECT code, min(date) FILTER (close IS NOT NULL) AS a, min(date) FILTER (returns IS NOT NULL AND abs(returns) > 2) AS b FROM panel GROUP BY code)
SELECT CAST(code AS VARCHAR) AS code, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS first FROM s UNION ALL SELECT 'all', max(greatest(a, b)) FILTER (a IS NOT NULL AND b IS NOT NULL) FROM s""")
def first_complete_dates(spark, sf_dir):
    """From when on each code has had a price and a large return, and when all that ever have."""
    bars = panel(spark, sf_dir).select("code", "date", "close", F.when(F.abs("returns") > 2, F.col("returns")).alias("large"))
    each = kept(quality.first_complete(bars, ["close", "large"]))
    return each.select(F.col("code").cast("string").alias("code"), "first").unionByName(each.agg(F.lit("all").alias("code"), F.max("first").alias("first")))


@query(f"""{PANEL}, f AS (SELECT code, date, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date) AS close FROM panel) SELECT code, CAST(date AS TIMESTAMP) AS date, {R('close', 'close')} FROM f""")
def validated_table(spark, sf_dir):
    """Prices under dates as text, some rows twice and some without a date: read, without repeats, and filled forward."""
    bars = panel(spark, sf_dir).select("code", F.concat(F.lit(" "), F.col("date").cast("string")).alias("date"), "close")
    messy = bars.unionByName(bars.where("code % 3 = 0")).unionByName(bars.where("code % 5 = 0").withColumn("date", F.lit("soon")))
    return neat(quality.validated(messy, ["code"], "date", {"close": "ffill"}, sort=False)[0], "code", "date")
