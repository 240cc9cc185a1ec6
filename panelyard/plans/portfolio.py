"""Queries from pools and sorts to positions and trades, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators import asof, backtest, cross_section, evaluation, portfolio, series
from panelyard.plans.research import BASE, CLIPS, FACTS, LABELS, PANEL, SNAPSHOTS, WEIGHTS, X_SQL, R, _universe, forward, labelled, neat, observations, weighted, xs
from panelyard.sources.panel import kept, load, panel

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STATUS = "st AS (SELECT code, date, CASE WHEN volume IS NULL THEN -1 WHEN (code + month(date)) % 5 = 0 THEN 0 ELSE 1 END AS status FROM panel)"


def status(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    return (panel(spark, sf_dir) if bars is None else bars).select("code", "date", F.when(F.col("volume").isNull(), -1).when((F.col("code") + F.month("date")) % 5 == 0, 0).otherwise(1).alias("status"))


@query(f"{PANEL}, {STATUS} SELECT date, code, 'normal' AS pool FROM st WHERE status = 1 UNION ALL SELECT date, code, 'listed' FROM st WHERE status <> -1")
def tradable_pool(spark, sf_dir):
    s = status(spark, sf_dir)
    return portfolio.tradable(s).withColumn("pool", F.lit("normal")).unionByName(portfolio.tradable(s, True).withColumn("pool", F.lit("listed")))


@query(f"""WITH {FACTS}, asked AS (SELECT code, input_ts + INTERVAL 10 HOUR AS input_ts FROM probes), hit AS (SELECT a.code, a.input_ts, f.datetime, f.value FROM asked a ASOF LEFT JOIN facts f ON a.code = f.code AND a.input_ts >= f.datetime)
SELECT code, input_ts, CASE WHEN epoch_us(input_ts) - epoch_us(datetime) <= 17520 * 3600000000 THEN value END AS value FROM hit""")
def prequery(spark, sf_dir):
    asked, facts = observations(spark, sf_dir)
    return asof.nearest(asked.withColumn("input_ts", F.col("input_ts") + F.expr("INTERVAL 10 HOURS")), facts, "before", 2 * 365 * 24).select("code", "input_ts", "value")


def _cut(x: str, n: int, by: str, k: int, source: str) -> str:
    grid = ", ".join(str(i / n) for i in range(n + 1))
    keys = " AND ".join(f"s.{c} IS NOT DISTINCT FROM e.{c}" for c in by.split(", "))
    return f"""e{k} AS (SELECT {by}, list_distinct(quantile_cont({x}, [{grid}])) AS e FROM {source} GROUP BY {by}),
s{k} AS (SELECT s.*, CASE WHEN len(e.e) > 1 THEN greatest(0, len(list_filter(e.e, lambda q: q < s.{x})) - 1) END AS label_{k} FROM {source} s JOIN e{k} e ON {keys})"""


THREE = f"{PANEL}, {X_SQL}, s0 AS (SELECT * FROM x WHERE x IS NOT NULL AND returns IS NOT NULL AND cap IS NOT NULL), {_cut('x', 2, 'date', 1, 's0')}, {_cut('returns', 2, 'date, label_1', 2, 's1')}, {_cut('cap', 3, 'date', 3, 's2')}"
STEPS = [("x", 2, False), ("returns", 2, True), ("cap", 3, False)]


@query(f"{THREE} SELECT code, date, CAST(label_1 AS INTEGER) AS label_1, CAST(label_2 AS INTEGER) AS label_2, CAST(label_3 AS INTEGER) AS label_3 FROM s3")
def nway_sort(spark, sf_dir):
    return portfolio.sorted_by(xs(spark, sf_dir), STEPS).select("code", "date", "label_1", "label_2", "label_3")


def _combined(labels: list[str]) -> str:
    high = " AND ".join(f"{c} = max({c}) OVER (PARTITION BY date)" for c in labels)
    low = " AND ".join(f"{c} = min({c}) OVER (PARTITION BY date)" for c in labels)
    return f"""{THREE}, hl AS (SELECT *, coalesce({high}, FALSE) AS h, coalesce({low}, FALSE) AS l FROM s3), sd AS (SELECT *, CASE WHEN h AND l THEN 0 WHEN h THEN 1 WHEN l THEN -1 ELSE 0 END AS s FROM hl)
SELECT code, date, {R('CAST(s AS DOUBLE) / count(*) OVER (PARTITION BY date, s)', 'weight')} FROM sd"""


@query(_combined(["label_1", "label_2"]))
def double_factor_weights(spark, sf_dir):
    return neat(portfolio.combination_weights(portfolio.sorted_by(xs(spark, sf_dir), STEPS), ["label_1", "label_2"]).select("code", "date", "weight"), "code", "date")


@query(_combined(["label_1", "label_2", "label_3"]))
def n_factor_weights(spark, sf_dir):
    return neat(portfolio.combination_weights(portfolio.sorted_by(xs(spark, sf_dir), STEPS), ["label_1", "label_2", "label_3"]).select("code", "date", "weight"), "code", "date")


HELD = f"{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, wt AS (SELECT code, date, weight FROM weights WHERE s > 0)"
EVERY = f"{HELD}, every AS (SELECT c.code, d.date, coalesce(w.weight, 0) AS weight FROM (SELECT DISTINCT code FROM wt) c CROSS JOIN (SELECT DISTINCT date FROM wt) d LEFT JOIN wt w ON w.code = c.code AND w.date = d.date)"


def held(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    return weighted(spark, sf_dir, bars).where("weight > 0").select("code", "date", "weight")


@query(f"{EVERY} SELECT code, date, {R('weight', 'weight')} FROM every")
def expanded_weights(spark, sf_dir):
    return neat(portfolio.expanded(held(spark, sf_dir)).select("code", "date", "weight"), "code", "date")


@query(f"""{HELD}, {SNAPSHOTS}, size_ AS (SELECT date, count(*) AS n FROM members GROUP BY date), j AS (SELECT w.date, w.code, m.code IS NULL AS o FROM wt w LEFT JOIN members m ON m.date = w.date AND m.code = w.code)
SELECT j.date, coalesce(any_value(n), 0) AS pool_size, count(*) AS selected, count(*) FILTER (o) AS outside, coalesce(array_to_string(list_slice(list_sort(list(j.code) FILTER (o)), 1, 20), ','), '') AS sample, count(*) FILTER (o) = 0 AS passed FROM j LEFT JOIN size_ s ON s.date = j.date GROUP BY j.date""")
def pool_check(spark, sf_dir):
    return portfolio.pool_check(held(spark, sf_dir), _universe(panel(spark, sf_dir))).withColumn("sample", F.array_join(F.transform("sample", lambda c: c.cast("string")), ","))


@query(f"{PANEL}, {X_SQL}, {LABELS} SELECT date, code, {R('x', 'value')}, CAST(label + 1 AS INTEGER) AS group FROM labels WHERE label IS NOT NULL".replace("AS group", 'AS "group"'))
def labels_to_values(spark, sf_dir):
    return neat(labelled(spark, sf_dir).where("label is not null").select("date", "code", F.col("x").alias("value"), (F.col("label") + 1).alias("group")), "date", "code", "group")


@query(f"""{PANEL}, {X_SQL}, a AS (SELECT code, date, returns, x FROM x WHERE returns IS NOT NULL AND x IS NOT NULL), b AS (SELECT date, count(*) AS n, coalesce(covar_samp(returns, x) / nullif(var_samp(x), 0), 0) AS b, avg(returns) AS my, avg(x) AS mx FROM a GROUP BY date)
SELECT code, date, {R('returns - my - b * (x - mx)', 'residual')} FROM a JOIN b USING (date) WHERE n >= 10""")
def factor_on_factor(spark, sf_dir):
    return neat(portfolio.residual(xs(spark, sf_dir), "returns", "x").select("code", "date", "residual"), "code", "date")


@query(f"{PANEL} SELECT code, date, industry FROM panel WHERE industry IN (1, 3)")
def industry_pool(spark, sf_dir):
    wanted = spark.createDataFrame([(1,), (3,)], "industry bigint")
    return panel(spark, sf_dir).select("code", "date", "industry").join(wanted, "industry", "left_semi").select("code", "date", "industry")


_Z = "z AS (SELECT code, date, cap, industry, coalesce((x - avg(x) OVER d) / nullif(stddev_samp(x) OVER d, 0), 0) AS x FROM w WINDOW d AS (PARTITION BY date))"


@query(f"""{PANEL}, {X_SQL.replace('FROM panel', 'FROM panel WHERE volume IS NOT NULL')}, {CLIPS['mad']}, w AS (SELECT code, date, cap, industry, CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END AS x FROM x LEFT JOIN lim USING (date)), {_Z},
u AS (SELECT code, date, x, ln(cap) AS c, coalesce(CAST(industry AS VARCHAR), min(CAST(industry AS VARCHAR)) OVER (PARTITION BY date)) AS g FROM z),
dm AS (SELECT code, date, x, g, x - avg(x) OVER (PARTITION BY date, g) AS y, c - avg(c) OVER (PARTITION BY date, g) AS q FROM u), b AS (SELECT date, sum(y * q) / nullif(sum(q * q), 0) AS b, count(*) AS n, count(DISTINCT g) + 1 AS k FROM dm GROUP BY date)
SELECT code, date, {R('CASE WHEN n < k + 5 THEN x ELSE y - coalesce(b, 0) * q END', 'x')} FROM dm JOIN b USING (date)""")
def preprocess_pipeline(spark, sf_dir):
    bars = cross_section.winsorize(xs(spark, sf_dir).where("x is not null"), "x", "mad", 2.0)
    bars = cross_section.standardize(bars, "x", "zscore").withColumn("c", F.ln("cap"))
    return neat(cross_section.neutralize(bars, "x", "industry", "c").select("code", "date", "x"), "code", "date")


@query(f"{PANEL}, {X_SQL}, g AS (SELECT date, coalesce(CAST(industry AS VARCHAR), 'none') AS \"group\", count(*) AS n, count(*) - count(x) AS missing FROM x GROUP BY 1, 2) SELECT date, \"group\", n, missing, {R('n / CAST(sum(n) OVER (PARTITION BY date) AS DOUBLE)', 'share')} FROM g")
def group_diagnostics(spark, sf_dir):
    return neat(portfolio.group_diagnostics(xs(spark, sf_dir), "x", "industry"), "date", "group", "n", "missing")


@query(f"{HELD}, g AS (SELECT date, sum(abs(weight)) AS g FROM wt GROUP BY date), k AS (SELECT count(*) FILTER (n > 1) AS repeated FROM (SELECT count(*) AS n FROM wt GROUP BY date, code)) SELECT count(*) AS rows, count(*) FILTER (weight IS NULL) AS missing, CAST(0 AS BIGINT) AS bad, any_value(repeated) AS repeated, (SELECT count(*) FROM g) AS dates, (SELECT count(*) FROM g WHERE g.g > 1 + 1e-9) AS over_one FROM wt, k")
def weight_report(spark, sf_dir):
    return portfolio.weight_report(held(spark, sf_dir))


def _suspended(rule: str, spark, sf_dir) -> DataFrame:
    bars = panel(spark, sf_dir, once=True)
    return neat(backtest.suspended(held(spark, sf_dir, bars), status(spark, sf_dir, bars), rule).select("code", "date", "weight"), "code", "date")


def _suspended_sql(rule: str) -> str:
    live = "CASE WHEN status = 0 THEN 0 ELSE weight END"
    value = live if rule == "to_cash" else f"coalesce({live} * sum(weight) OVER (PARTITION BY date) / nullif(sum({live}) OVER (PARTITION BY date), 0), 0)"
    return f"{HELD}, {STATUS}, j AS (SELECT w.code, w.date, weight, coalesce(status, 1) AS status FROM wt w LEFT JOIN st ON st.code = w.code AND st.date = w.date) SELECT code, date, {R(value, 'weight')} FROM j"


for _r in ("to_cash", "redistribute"):
    QUERIES[f"suspended_{_r}"] = partial(_suspended, _r)
    ORACLE_SQL[f"suspended_{_r}"] = _suspended_sql(_r)

RARE = "st AS (SELECT code, date, CASE WHEN (code * 7 + month(date) * 3 + year(date)) % 41 = 0 THEN 0 ELSE 1 END AS status FROM panel)"


@query(f"""{EVERY}, {RARE}, j AS (SELECT e.date, max(CAST(weight <> 0 AND status = 0 AS INTEGER)) AS h FROM every e JOIN st USING (code, date) GROUP BY e.date), src AS (SELECT date, last_value(CASE WHEN h = 0 THEN date END IGNORE NULLS) OVER (ORDER BY date) AS source FROM j)
SELECT e.code, e.date, {R('coalesce(o.weight, 0)', 'weight')} FROM every e JOIN src ON src.date = e.date LEFT JOIN every o ON o.date = source AND o.code = e.code""")
def suspended_hold(spark, sf_dir):
    bars = panel(spark, sf_dir, once=True)
    halted = bars.select("code", "date", F.when((F.col("code") * 7 + F.month("date") * 3 + F.year("date")) % 41 == 0, 0).otherwise(1).alias("status"))
    return neat(portfolio.held_over(kept(portfolio.expanded(held(spark, sf_dir, bars))), halted).select("code", "date", "weight"), "code", "date")


@query(f"""WITH {FACTS}, reb AS (SELECT code, input_ts AS start_ts, coalesce(lead(input_ts) OVER (PARTITION BY code ORDER BY input_ts), input_ts + INTERVAL 240 HOUR) AS end_ts FROM probes)
SELECT r.code, start_ts, min(datetime) AS datetime, arg_min(value, datetime) AS price FROM reb r LEFT JOIN facts f ON f.code = r.code AND datetime > start_ts AND datetime < end_ts GROUP BY r.code, start_ts""")
def execution_price(spark, sf_dir):
    asked, facts = observations(spark, sf_dir)
    return asof.execution_prices(asked.withColumnRenamed("input_ts", "start_ts"), facts, 240).select("code", "start_ts", "datetime", F.col("value").alias("price"))


QUARTERS = "qd AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('quarter', date)), reb AS (SELECT p.code, p.date, close AS price FROM panel p JOIN qd USING (date))"


@query(f"{PANEL}, {QUARTERS} SELECT code, date, {R('coalesce(price / nullif(lag(price) OVER (PARTITION BY code ORDER BY date), 0) - 1, 0)', 'ret')} FROM reb")
def period_returns(spark, sf_dir):
    bars = panel(spark, sf_dir)
    reb = bars.join(asof.period_ends(bars, "Q"), "date", "left_semi").select("code", "date", F.col("close").alias("price"))
    return neat(portfolio.period_returns(reb).select("code", "date", "ret"), "code", "date")


POSITIONS = f"""{PANEL}, {QUARTERS}, eq AS (SELECT code, date, CAST(price IS NOT NULL AS INTEGER) / CAST(count(price) OVER (PARTITION BY date) AS DOUBLE) AS weight FROM reb),
cl AS (SELECT p.code, p.date, weight, last_value(close IGNORE NULLS) OVER (PARTITION BY p.code ORDER BY p.date) AS c FROM panel p LEFT JOIN eq ON eq.code = p.code AND eq.date = p.date),
sh AS (SELECT code, date, coalesce(c, 0) AS c, coalesce(last_value(CASE WHEN weight IS NOT NULL THEN coalesce(weight * 1e6 / nullif(c, 0), 0) END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date), 0) AS shares FROM cl),
pos AS (SELECT date, code, shares, c AS close, shares * c AS value, coalesce(lag(shares) OVER w * (c - lag(c) OVER w), 0) AS pnl FROM sh WINDOW w AS (PARTITION BY code ORDER BY date))"""


def _positions(spark, sf_dir) -> DataFrame:
    bars = panel(spark, sf_dir)
    equal = cross_section.equal_weights(bars.join(asof.period_ends(bars, "Q"), "date", "left_semi"), "close")
    return portfolio.positions(equal, bars.select("code", "date", "close"), 1e6)


@query(f"{POSITIONS} SELECT date, code, {R('shares', 'shares')}, {R('close', 'close')}, {R('value', 'value')}, {R('pnl', 'pnl')} FROM pos")
def daily_positions(spark, sf_dir):
    return neat(_positions(spark, sf_dir), "date", "code")


@query(f"{POSITIONS}, d AS (SELECT date, sum(value) AS value, sum(pnl) AS pnl FROM pos GROUP BY date) SELECT date, {R('value', 'value')}, {R('pnl', 'pnl')}, {R('1 + sum(pnl) OVER (ORDER BY date) / 1e6', 'nav')} FROM d")
def portfolio_nav(spark, sf_dir):
    return neat(portfolio.book(_positions(spark, sf_dir), 1e6), "date")


@query(f"{POSITIONS} SELECT date, code, {R('value', 'value')}, {R('pnl', 'pnl')}, {R('value / nullif(sum(value) OVER (PARTITION BY date), 0)', 'weight_share')}, {R('abs(pnl) / nullif(sum(abs(pnl)) OVER (PARTITION BY date), 0)', 'pnl_share')} FROM pos QUALIFY shares <> 0")
def position_table(spark, sf_dir):
    return neat(portfolio.position_table(_positions(spark, sf_dir)).select("date", "code", "value", "pnl", "weight_share", "pnl_share"), "date", "code")


@query(f"""{BASE}, g AS (SELECT date, label, avg(forward) AS ret FROM f WHERE label IS NOT NULL GROUP BY date, label), s AS (SELECT date, -1 AS label, arg_max(ret, label) - arg_min(ret, label) AS ret FROM g WHERE ret IS NOT NULL GROUP BY date), a AS (SELECT * FROM g UNION ALL BY NAME SELECT * FROM s)
SELECT date, CAST(label AS INTEGER) AS label, {R('ret', 'ret')}, {R('exp(sum(ln(1 + greatest(coalesce(ret, 0), -0.999999))) OVER (PARTITION BY label ORDER BY date))', 'nav')} FROM a""")
def group_navs(spark, sf_dir):
    return neat(portfolio.group_navs(evaluation.group_returns(forward(spark, sf_dir), "label", "forward")), "date", "label")


@query(f"{EVERY}, d AS (SELECT date, sum(abs(weight - coalesce(before, 0))) / 2 AS t FROM (SELECT *, lag(weight) OVER (PARTITION BY code ORDER BY date) AS before FROM every) GROUP BY date) SELECT count(*) AS rebalances, {R('avg(t)', 'mean')}, {R('avg(t) * 365 / (date_diff(' + repr('day') + ', min(date), max(date)) / CAST(count(*) - 1 AS DOUBLE))', 'annual')} FROM d")
def annual_turnover(spark, sf_dir):
    return neat(series.annual_turnover(series.turnover(portfolio.expanded(held(spark, sf_dir)))), "rebalances")


@query(f"{HELD} SELECT code, {R('avg(abs(weight))', 'mean')}, count(*) AS periods FROM wt GROUP BY code ORDER BY round(avg(abs(weight)), 12) DESC, code LIMIT 20")
def top_holdings(spark, sf_dir):
    return neat(portfolio.top_holdings(held(spark, sf_dir), 20), "code", "periods")


@query(f"{EVERY}, s AS (SELECT code, weight, CAST(weight <> 0 AND coalesce(lag(weight) OVER (PARTITION BY code ORDER BY date), 0) = 0 AS INTEGER) AS s FROM every) SELECT code, CAST(sum(s) AS BIGINT) AS spans, {R('count(*) / CAST(sum(s) AS DOUBLE)', 'mean_length')} FROM s WHERE weight <> 0 GROUP BY code")
def holding_spans(spark, sf_dir):
    return neat(portfolio.holding_spans(portfolio.expanded(held(spark, sf_dir))), "code", "spans")


@query(f"{HELD}, b AS (SELECT p.code, returns, lag(weight) OVER (PARTITION BY p.code ORDER BY p.date) AS b FROM panel p LEFT JOIN wt ON wt.code = p.code AND wt.date = p.date) SELECT code, {R('sum(coalesce(b * returns, 0))', 'contribution')} FROM b GROUP BY code")
def return_contribution(spark, sf_dir):
    return neat(portfolio.contributions(held(spark, sf_dir), panel(spark, sf_dir).select("code", "date", F.col("returns").alias("ret"))), "code")


@query("""WITH t AS (SELECT o_custkey AS code, o_orderkey, o_orderdate AS time, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS d FROM orders WHERE o_orderstatus IN ('F', 'O')),
b AS (SELECT *, sum(d) OVER (PARTITION BY code ORDER BY time, o_orderkey) AS s FROM t), m AS (SELECT *, coalesce(min(s) OVER (PARTITION BY code ORDER BY time, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY code, d ORDER BY time, o_orderkey) AS n FROM m WHERE d = 1 OR s >= least(low, 0)) SELECT x.code, x.n, y.time AS bought, x.time AS sold FROM n x JOIN n y ON x.code = y.code AND x.n = y.n AND x.d = -1 AND y.d = 1""")
def fifo_trade_pairs(spark, sf_dir):
    trades = load(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").select(F.col("o_custkey").alias("code"), "o_orderkey", F.col("o_orderdate").alias("time"), F.when(F.col("o_orderstatus") == "F", "buy").otherwise("sell").alias("side"))
    return portfolio.trade_pairs(trades, ["time", "o_orderkey"]).select("code", F.col("n").cast("long").alias("n"), "bought", "sold")


@query(f"""{PANEL}, nav AS (SELECT code, date, close AS nav FROM panel WHERE close IS NOT NULL), r AS (SELECT code, date, year(date) AS year, nav, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER w - 1 AS dd FROM nav WINDOW w AS (PARTITION BY code, year(date) ORDER BY date))
SELECT code, CAST(year AS INTEGER) AS year, count(*) AS n, {R('arg_max(nav, date) / arg_min(nav, date) - 1', 'total')}, {R('stddev_samp(ret)', 'volatility')}, {R('min(dd)', 'max_drawdown')} FROM r GROUP BY code, year HAVING count(*) >= 5""")
def annual_report(spark, sf_dir):
    return neat(portfolio.annual_report(panel(spark, sf_dir).where("close is not null").select("code", "date", F.col("close").alias("nav"))), "code", "year", "n")


@query(f"""{HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, code) AS r FROM wt), c AS (SELECT code FROM r WHERE r <= 10 GROUP BY code ORDER BY max(weight) DESC, code LIMIT 25)
SELECT date, CASE WHEN c.code IS NOT NULL THEN CAST(wt.code AS VARCHAR) ELSE 'other' END AS name, {R('sum(weight)', 'weight')} FROM wt LEFT JOIN c ON c.code = wt.code GROUP BY 1, 2 UNION ALL SELECT date, 'cash', {R('1 - sum(weight)', 'weight')} FROM wt GROUP BY date""")
def daily_weight_table(spark, sf_dir):
    return neat(portfolio.regrouped(held(spark, sf_dir)), "date", "name")


@query(f"{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(x, 10) DESC, code) AS rank FROM weights) SELECT date, code, {R('weight', 'weight')}, {R('x', 'value')}, CAST(label + 1 AS INTEGER) AS \"group\", CAST(rank AS INTEGER) AS rank FROM k WHERE weight <> 0")
def rebalance_table(spark, sf_dir):
    return neat(portfolio.rebalance_table(weighted(spark, sf_dir), "x"), "date", "code", "group", "rank").select("date", "code", "weight", "value", "group", "rank")


@query(f"{PANEL}, t AS (SELECT l_suppkey AS code, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2), c AS (SELECT code, date AS priced_on, close FROM panel WHERE close IS NOT NULL) SELECT t.code, t.date, n, CAST(priced_on AS VARCHAR) AS priced_on, {R('close', 'price')} FROM t ASOF LEFT JOIN c ON t.code = c.code AND t.date <= c.priced_on")
def trade_markers(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    marks = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("code"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    found = asof.at_or_after(marks, panel(spark, sf_dir).where("close is not null").select("code", F.col("date").alias("priced_on"), F.col("close").alias("price")), "date", "priced_on")
    return neat(found.select("code", "date", "n", F.col("priced_on").cast("string").alias("priced_on"), "price"), "code", "date", "n", "priced_on")


@query(f"""{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, j AS (SELECT p.code, p.date, p.returns, CAST(sign(coalesce(weight, 0)) AS INTEGER) AS side FROM panel p LEFT JOIN weights w ON w.code = p.code AND w.date = p.date),
c AS (SELECT *, coalesce(CAST(side <> lag(side) OVER (PARTITION BY code ORDER BY date) AS INTEGER), 1) AS c FROM j), g AS (SELECT *, sum(c) OVER (PARTITION BY code ORDER BY date) AS segment FROM c)
SELECT code, CAST(segment AS BIGINT) AS segment, side, min(date) AS start, max(date) AS "end", count(*) AS length, {R('exp(sum(ln(1 + greatest(side * coalesce(returns, 0), -0.999999)))) - 1', 'ret')} FROM g WHERE side <> 0 GROUP BY code, segment, side""")
def trade_segments(spark, sf_dir):
    full = panel(spark, sf_dir).select("code", "date", "returns").join(weighted(spark, sf_dir).select("code", "date", "weight"), ["code", "date"], "left")
    return neat(portfolio.trade_segments(full, "returns"), "code", "segment", "side", "start", "end", "length")


@query("""WITH c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), n AS (SELECT date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC) AS n, count(*) OVER (PARTITION BY date_trunc('month', date)) AS k FROM c) SELECT date FROM n WHERE n BETWEEN 4 AND 9 AND k >= 9""")
def month_end_mask(spark, sf_dir):
    return portfolio.last_days(load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")), 9, 4)
