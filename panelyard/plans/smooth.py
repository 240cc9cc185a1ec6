"""Queries of exponential means, drawdowns over windows and weights from events' histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import series, smoothing, timing
from panelyard.plans.research import PANEL, R, neat
from panelyard.sources.panel import kept, panel

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def mean_sql(name: str, source: str, x: str, alpha: str) -> str:
    """Recursive CTEs that end in `name` (code, date, y): one bar after the other."""
    return f"""{name}_n AS MATERIALIZED (SELECT code, date, {x} AS x, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM {source}),
{name}_r AS (SELECT code, date, k, CAST(x AS DOUBLE) AS y, CAST(1.0 AS DOUBLE) AS w FROM {name}_n WHERE k = 1 UNION ALL
  SELECT n.code, n.date, n.k, CASE WHEN n.x IS NULL THEN r.y WHEN r.y IS NULL THEN n.x ELSE (r.w * (1 - {alpha}) * r.y + {alpha} * n.x) / (r.w * (1 - {alpha}) + {alpha}) END,
  CASE WHEN n.x IS NULL AND r.y IS NOT NULL THEN r.w * (1 - {alpha}) ELSE 1.0 END FROM {name}_r r JOIN {name}_n n ON n.code = r.code AND n.k = r.k + 1),
{name} AS (SELECT code, date, y FROM {name}_r)"""


_RECURSIVE = PANEL.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_RECURSIVE}, {mean_sql('em', 'panel', 'close', '(2.0 / 13)')} SELECT code, date, {R('y', 'ema')} FROM em")
def exponential_mean(spark, sf_dir):
    """The closing price's exponential mean of a span of 12 bars."""
    return neat(smoothing.span_mean(panel(spark, sf_dir).select("code", "date", "close"), "close", 12, "ema").select("code", "date", "ema"), "code", "date")


def _rsi_sql(n: int) -> str:
    return f"""{_RECURSIVE}, df AS (SELECT code, date, close - lag(close) OVER (PARTITION BY code ORDER BY date) AS d FROM panel), {mean_sql('up', 'df', 'CASE WHEN d IS NOT NULL THEN greatest(d, 0) END', f'(1.0 / {n})')}, {mean_sql('ab', 'df', 'abs(d)', f'(1.0 / {n})')}
SELECT code, date, {R('up.y / nullif(ab.y, 0) * 100', 'rsi')} FROM up JOIN ab USING (code, date)"""


@query(_rsi_sql(6))
def factor_rsi_fast(spark, sf_dir):
    return neat(smoothing.relative_strength(kept(panel(spark, sf_dir).select("code", "date", "close")), "close", 6), "code", "date").select("code", "date", "rsi")


@query(_rsi_sql(24))
def factor_rsi_slow(spark, sf_dir):
    return neat(smoothing.relative_strength(kept(panel(spark, sf_dir).select("code", "date", "close")), "close", 24), "code", "date").select("code", "date", "rsi")


@query(f"""{PANEL}, rw AS MATERIALIZED (SELECT code, date, returns AS x, high, row_number() OVER (PARTITION BY code ORDER BY date) AS i, coalesce(returns > 0.1, FALSE) AS a FROM panel),
st AS (SELECT *, a AND NOT coalesce(lag(a) OVER (PARTITION BY code ORDER BY i), FALSE) AS s FROM rw), rn AS MATERIALIZED (SELECT *, CASE WHEN a THEN sum(CAST(s AS INTEGER)) OVER (PARTITION BY code ORDER BY i) END AS run FROM st),
ev AS (SELECT code, run, min(i) AS s, max(i) AS e, count(*) AS length, sum(x) AS total, max(high) AS level FROM rn WHERE run IS NOT NULL GROUP BY 1, 2),
nh AS MATERIALIZED (SELECT ev.*, (SELECT min(r.i) FROM rw r WHERE r.code = ev.code AND r.i > ev.e AND r.high > ev.level) AS at FROM ev),
pr AS (SELECT a.code, a.run, b.length, b.total, b.e AS be, b.e IS NOT NULL AND b.at < a.s AS known, b.at - b.e AS wait FROM nh a JOIN nh b ON b.code = a.code AND b.e < a.s),
h1 AS (SELECT code, run, count(*) AS n, avg(total) AS m, quantile_cont(length, 0.65) AS d FROM (SELECT *, row_number() OVER (PARTITION BY code, run ORDER BY be DESC) AS k FROM pr) WHERE k <= 10 GROUP BY 1, 2),
h2 AS (SELECT code, run, quantile_cont(wait, 0.75) AS w FROM (SELECT *, row_number() OVER (PARTITION BY code, run ORDER BY be DESC) AS k FROM pr WHERE known) WHERE k <= 10 GROUP BY 1, 2),
jd AS (SELECT nh.code, nh.run, nh.e, m, greatest(1, CAST(ceil(round(d, 9)) AS INTEGER)) AS open, coalesce(greatest(0, CAST(ceil(round(w, 9)) AS INTEGER)), 5) AS hold FROM nh JOIN h1 USING (code, run) LEFT JOIN h2 USING (code, run) WHERE n >= 3 AND abs(m) > 1e-12),
ac AS (SELECT code, run, i, row_number() OVER w AS day, sum(x) OVER w AS sofar FROM rn WHERE run IS NOT NULL WINDOW w AS (PARTITION BY code, run ORDER BY i)),
er AS (SELECT ac.code, ac.i, least(1, greatest(0, sofar / m)) AS weight, e, hold FROM ac JOIN jd USING (code, run) WHERE day >= open),
al AS (SELECT code, i, weight FROM er UNION ALL SELECT code, unnest(generate_series(e + 1, e + hold)), weight FROM er WHERE i = e AND weight > 0 AND hold > 0), bs AS (SELECT code, i, max(weight) AS weight FROM al GROUP BY 1, 2)
SELECT rw.code, date, {R('coalesce(weight, 0)', 'weight')} FROM rw LEFT JOIN bs USING (code, i)""")
def event_history_weights(spark, sf_dir):
    """Runs of months with returns over 10 %, weighted by what a supplier's earlier runs were like."""
    bars = kept(panel(spark, sf_dir).select("code", "date", "returns", "high"))
    return neat(timing.event_history_weights(bars, "returns", "high", 0.1), "code", "date")


@query(f"""{PANEL}, v AS (SELECT code, date, close FROM panel WHERE close IS NOT NULL), l AS (SELECT code, date, list(close) OVER w AS h, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT code, date, {R('CASE WHEN n = 12 THEN list_min(list_transform(h, lambda x, i: x / list_max(h[:i]) - 1)) END', 'rolling_drawdown')} FROM l""")
def rolling_drawdown(spark, sf_dir):
    """The deepest fall within twelve bars of the closing price."""
    return neat(series.rolling_drawdown(panel(spark, sf_dir).where("close IS NOT NULL").select("code", "date", "close"), 12, "close").drop("close"), "code", "date")
