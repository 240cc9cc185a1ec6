"""Queries of the reading and loading operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import asof, cross_section, quality
from panelyard.plans.research import FACTS, PANEL, X_SQL, R, neat, observations, xs
from panelyard.sources import access, ingest
from panelyard.sources.panel import load, panel, spread

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


OBS = """obs AS (SELECT code, datetime, unnest(['high', 'low']) AS metric, unnest([hi, lo]) AS value FROM (SELECT l_suppkey AS code, CAST(o_orderdate AS TIMESTAMP) AS datetime, max(o_totalprice) AS hi, min(o_totalprice) AS lo
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2))"""


def obs(spark, sf_dir) -> DataFrame:
    """Order values by supplier and time as long observations: code, datetime, metric, value."""
    whole = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = whole.count()
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    both = spread(orders, rows, "o_orderkey").join(spread(whole, rows, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    by_code = spread(both.select(F.col("l_suppkey").alias("code"), F.col("o_orderdate").cast("timestamp").alias("datetime"), "o_totalprice"), rows, "code").groupBy("code", "datetime")
    return ingest.melted(by_code.agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low")), ["code", "datetime"])


@query(f"WITH {OBS} SELECT code, datetime, value FROM obs WHERE metric = 'high' AND datetime >= TIMESTAMP '1996-03-01' AND datetime < TIMESTAMP '1998-07-01'")
def time_range_scan(spark, sf_dir):
    return access.in_time_range(obs(spark, sf_dir).where("metric = 'high'"), "1996-03-01", "1998-06-30").select("code", "datetime", "value").orderBy(F.desc("datetime"), "code")


@query("""WITH d AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date FROM lineitem), m AS (SELECT 'open' AS metric, to_seconds(34201) AS t UNION ALL SELECT 'close', to_seconds(54001))
SELECT code, metric, count(*) AS n, min(date) AS first, max(date) AS last FROM d, m WHERE date + t >= TIMESTAMP '1996-03-01 10:00:00' AND date + t <= TIMESTAMP '1999-03-01 12:00:00' GROUP BY code, metric""")
def availability_bounds(spark, sf_dir):
    days = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"))
    parts = [access.known_within(days, "1996-03-01 10:00:00", "1999-03-01 12:00:00", m).groupBy("code").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).withColumn("metric", F.lit(m)) for m in ("open", "close")]
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'")
def conditional_select(spark, sf_dir):
    return access.selected(load(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "O"], "o_totalprice": (">", 100000), "o_orderpriority": ("!=", "5-LOW")}, ["o_orderkey", "o_custkey", "o_totalprice"])


@query(f"WITH {OBS} SELECT DISTINCT code, metric, CAST(datetime AS DATE) AS date FROM obs WHERE datetime >= TIMESTAMP '1997-01-01'")
def available_dates(spark, sf_dir):
    return access.in_time_range(obs(spark, sf_dir), "1997-01-01").select("code", "metric", F.to_date("datetime").alias("date")).distinct()


@query(f"WITH {OBS} SELECT code, metric, max(datetime) AS latest FROM obs GROUP BY code, metric")
def latest_date(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("code", "metric").agg(F.max("datetime").alias("latest"))


@query("SELECT DISTINCT 'o_orderstatus' AS column, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def distinct_values(spark, sf_dir):
    return access.distinct_values(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE contains(lower(concat_ws(' ', o_orderkey, o_custkey, o_orderpriority)), '5-low'))
SELECT o_orderkey, o_custkey, o_orderpriority, (SELECT count(*) FROM s) AS total FROM s ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100""")
def search_page(spark, sf_dir):
    found = access.searched(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "5-LOW")
    return access.numbered_page(found, [F.desc("o_orderkey")], 100, 50)


@query(f"WITH {OBS} SELECT code, datetime, metric, value FROM obs WHERE datetime < TIMESTAMP '1999-01-01' OR (datetime = TIMESTAMP '1999-01-01' AND (code > 3 OR (code = 3 AND metric > 'high'))) ORDER BY datetime DESC, code, metric LIMIT 500")
def keyset_page(spark, sf_dir):
    return ingest.page(obs(spark, sf_dir), 500, ("1999-01-01", 3, "high"))


@query(f"""WITH {OBS}, ends AS (SELECT max(CAST(l_shipdate AS DATE)) AS date FROM lineitem GROUP BY date_trunc('quarter', l_shipdate)), h AS (SELECT code, CAST(datetime AS DATE) AS date, max(value) AS value FROM obs GROUP BY 1, 2)
SELECT c.code, e.date, h.value FROM (SELECT DISTINCT code FROM h) c CROSS JOIN ends e ASOF LEFT JOIN h ON h.code = c.code AND e.date >= h.date""")
def aligned_to_dates(spark, sf_dir):
    ends = asof.period_ends(load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")), "Q")
    daily = obs(spark, sf_dir).groupBy("code", F.to_date("datetime").alias("date")).agg(F.max("value").alias("value"))
    return access.aligned(daily, ends, "value")


@query("""WITH l AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_max(value, struct_pack(a := ts, b := value)) AS value FROM events GROUP BY 1, 2, 3), t AS (SELECT CAST(ts AS DATE) AS day, max(ts) AS ts FROM events GROUP BY 1) SELECT user_id, event_type, day, value, ts FROM l JOIN t USING (day)""")
def canonical_days(spark, sf_dir):
    return access.canonical_days(load(spark, sf_dir, "events"), ["user_id", "event_type"], "value")


@query(f"{PANEL}, q AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('quarter', date)) SELECT code, date, {R('close', 'close')} FROM panel SEMI JOIN q USING (date) WHERE close IS NOT NULL")
def signal_date_slice(spark, sf_dir):
    bars = panel(spark, sf_dir)
    return neat(bars.join(asof.period_ends(bars, "Q"), "date", "left_semi").where("close is not null").select("code", "date", "close"), "code", "date")


@query(f"SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, {R('avg(l_extendedprice)', 'price')} FROM lineitem GROUP BY 1, 2")
def metric_panel(spark, sf_dir):
    return neat(access.panel_of(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price")), "price"), "code", "date")


NAMES = """named AS (SELECT o_custkey AS code, o_orderdate AS datetime, max(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END) AS name FROM orders GROUP BY 1, 2), current_ AS (SELECT code, arg_max(name, datetime) AS name FROM named WHERE trim(name) <> '' GROUP BY code)"""


def _names(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return ingest.current_names(o.groupBy(F.col("o_custkey").alias("code"), F.col("o_orderdate").alias("datetime")).agg(F.max(F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority"))).alias("name")))


@query(f"WITH {NAMES} SELECT code, name FROM current_")
def current_names(spark, sf_dir):
    return _names(spark, sf_dir)


@query(f"WITH {NAMES} SELECT c_custkey AS code, coalesce(name, CAST(c_custkey AS VARCHAR)) AS name FROM customer LEFT JOIN current_ ON code = c_custkey")
def display_names(spark, sf_dir):
    return access.named(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")), _names(spark, sf_dir))


@query(f"WITH {OBS} SELECT code, datetime, max(value) FILTER (metric = 'high') AS high, max(value) FILTER (metric = 'low') AS low FROM obs GROUP BY 1, 2")
def long_to_wide(spark, sf_dir):
    return ingest.pivoted(obs(spark, sf_dir), ["code", "datetime"], ["high", "low"])


MEMBERS = """hist AS (SELECT l_suppkey AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'pri_2021' ELSE 'pri_2014' END AS scheme, CAST(o_orderdate AS TIMESTAMP) AS datetime, max(o_orderpriority) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
member AS (SELECT code, scheme, value, datetime AS valid_from, lead(datetime) OVER (PARTITION BY code, scheme ORDER BY datetime) AS valid_to FROM hist)"""


def _membership(spark, sf_dir) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    scheme = F.when(F.col("o_orderkey") % 2 == 0, "pri_2021").otherwise("pri_2014")
    hist = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("code"), scheme.alias("scheme"), F.col("o_orderdate").cast("timestamp").alias("datetime")).agg(F.max("o_orderpriority").alias("value"))
    return ingest.membership(hist)


@query(f"WITH {MEMBERS} SELECT code, scheme, value, valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM member")
def membership_intervals(spark, sf_dir):
    return _membership(spark, sf_dir).withColumn("valid_to", F.col("valid_to").cast("string"))


def _lookup_sql(kind: str, test: str) -> str:
    return f"""SELECT '{kind}' AS kind, code, input_ts, max_by(value, struct_pack(a := valid_from, b := scheme)) AS value FROM (SELECT p.code, input_ts, valid_from, scheme, value FROM probes p LEFT JOIN member m ON p.code = m.code AND valid_from <= input_ts AND (valid_to IS NULL OR valid_to > input_ts) AND {test}) GROUP BY code, input_ts"""


@query(f"WITH {FACTS}, {MEMBERS} {_lookup_sql('exact', "scheme = 'pri_2014'")} UNION ALL {_lookup_sql('prefix', "starts_with(scheme, 'pri')")}")
def industry_lookup(spark, sf_dir):
    asked, _ = observations(spark, sf_dir)
    spells = _membership(spark, sf_dir)
    exact = asof.labels_at(asked, spells, "pri_2014", exact=True).withColumn("kind", F.lit("exact"))
    return exact.unionByName(asof.labels_at(asked, spells, "pri").withColumn("kind", F.lit("prefix"))).select("kind", "code", "input_ts", "value")


@query(f"WITH {MEMBERS}, latest AS (SELECT code, max_by(value, struct_pack(a := valid_from, b := scheme)) AS value FROM member WHERE valid_from <= TIMESTAMP '1998-01-01' GROUP BY code) SELECT code, value FROM latest WHERE value = '5-LOW'")
def industry_members(spark, sf_dir):
    return asof.members_at(_membership(spark, sf_dir), "1998-01-01", ["5-LOW"])


@query("WITH e AS (SELECT max(CAST(l_shipdate AS DATE)) AS input_ts FROM lineitem GROUP BY date_trunc('quarter', l_shipdate)), n AS (SELECT input_ts, CAST(row_number() OVER (ORDER BY input_ts) - 1 AS INTEGER) AS ordinal FROM e) SELECT s_suppkey AS code, ordinal, input_ts FROM supplier, n")
def probe_grid(spark, sf_dir):
    ends = asof.period_ends(load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")), "Q").withColumnRenamed("date", "input_ts")
    return access.probes(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code")), ends)


@query(f"{PANEL}, {X_SQL}, a AS (SELECT code, date, x FROM x WHERE x IS NOT NULL), b AS (SELECT code, date, returns FROM x WHERE returns IS NOT NULL), c AS (SELECT code, date, ln(cap) AS log_cap FROM x WHERE code % 3 <> 0) SELECT a.code, a.date, {R('x', 'x')}, {R('returns', 'returns')}, {R('log_cap', 'log_cap')} FROM a JOIN b USING (code, date) LEFT JOIN c USING (code, date)")
def factor_merge(spark, sf_dir):
    bars, keys = xs(spark, sf_dir), ["code", "date"]
    cap = bars.where("code % 3 != 0").select("code", "date", F.ln("cap").alias("log_cap"))
    return neat(bars.where("x is not null").select("code", "date", "x").join(bars.where("returns is not null").select("code", "date", "returns"), keys).join(cap, keys, "left"), *keys)


@query("WITH d AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem) SELECT s_suppkey AS code, date FROM supplier, d EXCEPT SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) FROM lineitem")
def missing_keys(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.trunc("l_shipdate", "month").alias("date"))
    wanted = access.probes(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code")), lines.select("date").distinct(), ts="date")
    rows = lines.count()
    return access.missing_keys(*(spread(df, rows, "code", "date") for df in (wanted, lines)), ["code", "date"])


@query(f"{PANEL}, {X_SQL}, s AS (SELECT max(date) AS signal FROM panel GROUP BY date_trunc('quarter', date)), d AS (SELECT date, max(signal) AS signal FROM (SELECT DISTINCT date FROM panel) JOIN s ON signal <= date GROUP BY date) SELECT d.date, d.signal, x.code, {R('x.x', 'x')} FROM d JOIN x ON x.date = d.signal WHERE x.x IS NOT NULL")
def factor_date_fallback(spark, sf_dir):
    bars = xs(spark, sf_dir)
    signals = asof.period_ends(bars, "Q").select(F.lit(1).alias("code"), F.col("date").cast("timestamp").alias("datetime"), F.col("date").alias("signal"))
    asked = bars.select(F.lit(1).alias("code"), F.col("date").cast("timestamp").alias("input_ts"), "date").distinct()
    at = asof.nearest(asked, signals).where("signal is not null").select("date", "signal")
    return neat(at.join(bars.select(F.col("date").alias("signal"), "code", "x").where("x is not null"), "signal"), "date", "signal", "code")


@query("WITH c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), b AS (SELECT date, lag(date) OVER (ORDER BY date) AS signal FROM c), m AS (SELECT max(date) AS date FROM c GROUP BY date_trunc('month', date)) SELECT date AS rebalance, CAST(signal AS VARCHAR) AS signal FROM b SEMI JOIN m USING (date)")
def signal_before_rebalance(spark, sf_dir):
    calendar = load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return access.day_before(calendar, asof.period_ends(calendar, "M")).withColumn("signal", F.col("signal").cast("string"))


@query(f"""{PANEL}, {X_SQL}, e AS (SELECT date, list_distinct(quantile_cont(x, [0, 0.5, 1])) AS ex, list_distinct(quantile_cont(returns, [0, 0.25, 0.5, 0.75, 1])) AS er FROM x WHERE x IS NOT NULL AND returns IS NOT NULL GROUP BY date),
l AS (SELECT x, returns, CASE WHEN len(ex) > 1 THEN greatest(0, len(list_filter(ex, lambda q: q < x)) - 1) END AS a, CASE WHEN len(er) > 1 THEN greatest(0, len(list_filter(er, lambda q: q < returns)) - 1) END AS b FROM x JOIN e USING (date) WHERE x IS NOT NULL AND returns IS NOT NULL)
SELECT coalesce(CAST(a AS VARCHAR), CASE WHEN grouping(a) = 1 THEN 'all' ELSE '0' END) AS label_1, coalesce(CAST(b AS VARCHAR), CASE WHEN grouping(b) = 1 THEN 'all' ELSE '0' END) AS label_2, count(*) AS n, {R('avg(x)', 'mean_1')}, {R('avg(returns)', 'mean_2')} FROM l GROUP BY CUBE (a, b)""")
def label_crosstab(spark, sf_dir):
    both = cross_section.double_sort(xs(spark, sf_dir), "x", "returns", 2, 4)
    return neat(cross_section.label_tables(both, ["label_1", "label_2"], ["x", "returns"]).withColumnsRenamed({"mean_x": "mean_1", "mean_returns": "mean_2"}), "label_1", "label_2", "n")


@query("SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS filled, max(o_totalprice) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey")
def conditional_aggregates(spark, sf_dir):
    top = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(top("F").alias("filled"), top("O").alias("open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


SNAP = f"{PANEL}, r AS (SELECT code, date, row_number() OVER (PARTITION BY date ORDER BY coalesce(amount, 0) DESC, code) - 1 AS ordinal, count(*) OVER (PARTITION BY date) AS size FROM panel), top AS (SELECT code, date, ordinal FROM r WHERE ordinal * 10 < size * 3)"


def _top(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("date")
    ranked = panel(spark, sf_dir).withColumn("ordinal", F.row_number().over(w.orderBy(F.coalesce("amount", F.lit(0.0)).desc(), "code")) - 1).withColumn("size", F.count("*").over(w))
    return ranked.where("ordinal * 10 < size * 3").select("code", "date", "ordinal")


@query(f"{SNAP} SELECT date, string_agg(CAST(code AS VARCHAR), ',' ORDER BY ordinal) AS constituents, count(*) AS n FROM top GROUP BY date")
def snapshot_load(spark, sf_dir):
    return ingest.snapshots(_top(spark, sf_dir), ["date"]).withColumn("constituents", F.array_join(F.transform("constituents", lambda c: c.cast("string")), ","))


@query(f"{SNAP} SELECT date, CAST(ordinal AS INTEGER) AS ordinal, code FROM top")
def constituents_explode(spark, sf_dir):
    return ingest.constituents(ingest.snapshots(_top(spark, sf_dir), ["date"]), ["date"])


@query("SELECT o_orderkey AS k, 'order' AS kind FROM orders UNION ALL SELECT l_orderkey, 'line' FROM lineitem")
def union_all(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind")).unionByName(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind")))


@query("SELECT CAST(o_orderdate AS DATE) AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def date_intersection(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).intersect(load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")))


@query("SELECT c_custkey AS code FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def code_difference(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code")).subtract(load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS lines FROM lineitem GROUP BY 1) SELECT coalesce(a.date, b.date) AS date, CAST(orders AS DOUBLE) AS orders, CAST(lines AS DOUBLE) AS lines FROM a FULL JOIN b ON a.date = b.date")
def outer_align(spark, sf_dir):
    of = lambda t, d, n: load(spark, sf_dir, t).groupBy(F.to_date(d).alias("date")).agg(F.count("*").cast("double").alias(n))
    return access.outer_aligned(of("orders", "o_orderdate", "orders"), of("lineitem", "l_shipdate", "lines"), ["date"])


# ---- loading -----------------------------------------------------------------------------------------------------

RAW = """raw AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS datetime, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE ' c' || o_custkey END AS code, 'price' AS metric,
CASE o_orderkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '12,5' WHEN 2 THEN '  ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS value FROM orders)"""


def raw(spark, sf_dir) -> DataFrame:
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long").cast("string")
    return load(spark, sf_dir, "orders").select(
        F.when(key % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("datetime"), F.when(key % 17 == 0, " ").otherwise(F.concat(F.lit(" c"), F.col("o_custkey"))).alias("code"), F.lit("price").alias("metric"),
        F.when(key % 7 == 0, "N/A").when(key % 7 == 1, "12,5").when(key % 7 == 2, F.concat(F.lit("  "), price)).otherwise(price).alias("value"),
    )


@query(f"WITH {RAW} SELECT CAST(datetime AS TIMESTAMP) AS datetime, trim(code) AS code, metric, CAST(trim(value) AS DOUBLE) AS value FROM raw WHERE datetime <> 'soon' AND trim(code) <> '' AND value NOT IN ('N/A', '12,5')")
def long_load(spark, sf_dir):
    return ingest.parsed(raw(spark, sf_dir))[0]


@query(f"""WITH {RAW} SELECT datetime, code, metric, value, 'datetime: not a time' AS reason FROM raw WHERE datetime = 'soon' UNION ALL SELECT datetime, code, metric, value, 'code: empty' FROM raw WHERE trim(code) = ''
UNION ALL SELECT datetime, code, metric, value, 'value: not a finite number' FROM raw WHERE value = '12,5'""")
def long_load_rejects(spark, sf_dir):
    return ingest.parsed(raw(spark, sf_dir))[1]


@query(f"{PANEL} SELECT code, date, metric, CAST(date AS TIMESTAMP) + CASE WHEN metric = 'open' THEN to_seconds(34201) ELSE to_seconds(54001) END AS available_at FROM (SELECT code, date, 'open' AS metric FROM panel WHERE open IS NOT NULL UNION ALL SELECT code, date, 'close' FROM panel WHERE close IS NOT NULL)")
def availability_times(spark, sf_dir):
    long = ingest.melted(panel(spark, sf_dir).select("code", "date", "open", "close"), ["code", "date"])
    return long.select("code", "date", "metric", ingest.available_at(long).alias("available_at"))


STATUS = f"{PANEL}, st AS (SELECT code, date, CASE WHEN volume IS NULL OR (code + month(date)) % 5 = 0 THEN 0 ELSE 1 END AS status FROM panel)"


@query(f"{STATUS}, f AS (SELECT *, min(CASE WHEN status = 1 THEN date END) OVER (PARTITION BY code) AS f FROM st) SELECT code, date, status FROM f WHERE status <> 1 OR date = f")
def sparse_status(spark, sf_dir):
    return ingest.sparse_status(panel(spark, sf_dir).select("code", "date", F.when(F.col("volume").isNull() | ((F.col("code") + F.month("date")) % 5 == 0), 0).otherwise(1).alias("status")))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 1 THEN event_type END AS text FROM events WHERE event_id % 3 <> 2 OR props IS NOT NULL")
def remark_parse(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.col("props")).alias("remark")).where("remark is not null")
    return ingest.remarks(e).select("event_id", F.col("remark")["k"].alias("k"), F.col("remark")["text"].alias("text"))


@query(f"WITH {OBS} SELECT code, CASE metric WHEN 'high' THEN 'order_high' ELSE metric END AS metric, count(*) AS n FROM obs GROUP BY 1, 2")
def alias_resolution(spark, sf_dir):
    aliases = spark.createDataFrame([("high", "order_high"), ("top", "order_high")], "alias string, canonical string")
    return ingest.resolved(obs(spark, sf_dir), aliases).groupBy("code", "metric").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS code, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS value, p_type AS name, 'brand' AS scheme FROM part WHERE regexp_extract(p_brand, '([0-9]+)', 1) <> ''")
def industry_load(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.lit("2024-01-01").alias("date"), F.col("p_type").alias("ind_name"), F.col("p_brand").alias("ind_code"), F.lit("brand").alias("scheme"))
    return ingest.industry_rows(rows).drop("date")


@query("SELECT DISTINCT 'ORDERS' AS exchange, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT DISTINCT 'FILLED', CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F'")
def calendar_load(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return ingest.calendars(load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "closed").otherwise(day).alias(" orders"), F.when(F.col("o_orderstatus") == "F", day).alias("filled ")))


@query(f"""WITH {OBS}, k AS (SELECT count(*) FILTER (n > 1) AS repeated_keys FROM (SELECT count(*) AS n FROM obs GROUP BY code, CAST(datetime AS DATE), metric))
SELECT count(*) AS rows, count(DISTINCT code) AS codes, count(DISTINCT metric) AS metrics, count(*) FILTER (value IS NULL) AS missing_values, CAST(0 AS BIGINT) AS bad_values, count(*) FILTER (datetime IS NULL) AS missing_times,
strftime(min(datetime), '%Y-%m-%d') AS first, strftime(max(datetime), '%Y-%m-%d') AS last, any_value(repeated_keys) AS repeated_keys FROM obs, k""")
def import_report(spark, sf_dir):
    out = ingest.report(obs(spark, sf_dir).withColumn("day", F.to_date("datetime")), ["code", "day", "metric"])
    return out.withColumns({c: F.substring(c, 1, 10) for c in ("first", "last")})


@query("""WITH old AS (SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS value FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN old.o_orderkey IS NULL THEN 'new' WHEN old.value IS NOT DISTINCT FROM new.value THEN 'same' ELSE 'changed' END AS state, count(*) AS rows FROM new LEFT JOIN old ON old.o_orderkey = new.o_orderkey GROUP BY 1""")
def change_inspection(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return ingest.changes(o.where("o_orderkey % 3 != 0"), o.where("o_orderkey % 5 != 0").withColumn("value", F.when(F.col("o_orderkey") % 2 == 0, F.col("value")).otherwise(F.col("value") + 1)), ["o_orderkey"], "value")


@query(f"{PANEL}, d AS (SELECT code, date, CASE WHEN date >= DATE '1998-01-01' AND code % 4 = 0 THEN NULL ELSE close END AS close FROM panel WHERE NOT (date < DATE '1996-01-01')) SELECT code, date, {R('close', 'close')} FROM d")
def deleted_values(spark, sf_dir):
    kept = ingest.without(panel(spark, sf_dir).select("code", "date", "close"), F.col("date") < "1996-01-01")
    return neat(ingest.without(kept, (F.col("date") >= "1998-01-01") & (F.col("code") % 4 == 0), ["close"]), "code", "date")


@query(f"WITH {OBS} SELECT metric, count(*) AS rows, count(DISTINCT code) AS codes, min(datetime) AS first, max(datetime) AS last, max(datetime) < (SELECT max(datetime) FROM obs) - INTERVAL 30 DAY AS stale FROM obs GROUP BY metric")
def dataset_coverage(spark, sf_dir):
    return quality.dataset_coverage(obs(spark, sf_dir), ["metric"], 30)


@query(f"""{PANEL} SELECT 'blank' AS issue, 'industry' AS column, count(*) FILTER (industry IS NULL) AS rows FROM panel UNION ALL SELECT 'not finite', 'close', count(*) FILTER (close IS NULL) FROM panel UNION ALL SELECT 'not finite', 'returns', count(*) FILTER (returns IS NULL) FROM panel""")
def integrity_diagnosis(spark, sf_dir):
    return ingest.integrity(panel(spark, sf_dir), ["industry"], ["close", "returns"])


@query(f"""{PANEL}, f AS (UNPIVOT (SELECT code, date, open, high, low, close, vwap, amount FROM panel) ON open, high, low, close, vwap, amount INTO NAME metric VALUE value), {OBS}
SELECT code, CAST(date AS TIMESTAMP) AS datetime, metric, {R('value', 'value')} FROM f UNION ALL SELECT code, datetime, 'order_' || metric, {R('value', 'value')} FROM obs""")
def fact_long_view(spark, sf_dir):
    facts = ingest.melted(panel(spark, sf_dir).select("code", "date", "open", "high", "low", "close", "vwap", "amount"), ["code", "date"]).select("code", F.col("date").cast("timestamp").alias("datetime"), "metric", "value")
    return neat(facts.unionByName(obs(spark, sf_dir).withColumn("metric", F.concat(F.lit("order_"), "metric"))), "code", "datetime", "metric")
