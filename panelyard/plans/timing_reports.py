"""Queries of the judgement of timing factors, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.operators import timing_report
from panelyard.plans.inference import t_p_sql
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


_ROWS = f"""{PANEL}, t0 AS (SELECT code, date, vwap AS x, vwap / nullif(lag(vwap) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel),
t1 AS (SELECT *, CASE WHEN count(ret) OVER w = 2 THEN sum(ret) OVER w END AS forward FROM t0 WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
t2 AS (SELECT code, date, ret, forward, round(coalesce((x - avg(x) OVER c) / nullif(stddev_samp(x) OVER c, 0), 0), 10) AS x FROM t1 WHERE x IS NOT NULL WINDOW c AS (PARTITION BY code)),
qs AS (SELECT code, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 1 - 0.1) AS hi FROM t2 GROUP BY code),
t3 AS (SELECT t2.*, lo, hi, avg(x) OVER c AS m, stddev_samp(x) OVER c AS s, round(avg(x) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 10) AS a, round(avg(x) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 10) AS l, x - lag(x) OVER w AS d FROM t2 JOIN qs USING (code) WINDOW c AS (PARTITION BY code), w AS (PARTITION BY code ORDER BY date)),
t4 AS (SELECT *, a - lag(a) OVER w AS da, l - lag(l) OVER w AS dl FROM t3 WINDOW w AS (PARTITION BY code ORDER BY date)),
sg AS MATERIALIZED (SELECT code, date, ret, forward, x, unnest(['band', 'average', 'extreme', 'sign', 'change', 'long_average_change', 'average_change']) AS rule, unnest([1, 2, 3, 4, 5, 6, 7]) AS rank, unnest([CASE WHEN x > m + s THEN 1 WHEN x < m - s THEN -1 ELSE 0 END, CASE WHEN x > a THEN 1 WHEN x < a THEN -1 ELSE 0 END,
  CASE WHEN x > hi THEN 1 WHEN x < lo THEN -1 ELSE 0 END, CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN -1 ELSE 0 END, CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN -1 ELSE 0 END, CASE WHEN dl > 0 THEN 1 WHEN dl < 0 THEN -1 ELSE 0 END, CASE WHEN da > 0 THEN 1 WHEN da < 0 THEN -1 ELSE 0 END]) AS signal FROM t4),
sp AS (SELECT *, row_number() OVER (PARTITION BY code, rule ORDER BY date) <= count(*) OVER (PARTITION BY code, rule) * 0.7 AS inside, (signal = 1 AND forward > 0) OR (signal = -1 AND forward < 0) AS good FROM sg WHERE forward IS NOT NULL),
te AS MATERIALIZED (SELECT code, rule, any_value(rank) AS rank, count(*) FILTER (signal = 1) AS n_up, count(*) FILTER (signal = -1) AS n_down, coalesce(count(*) FILTER (good) / nullif(CAST(count(*) FILTER (signal <> 0) AS DOUBLE), 0), 0) AS hit,
  coalesce(count(*) FILTER (good AND inside) / nullif(CAST(count(*) FILTER (signal <> 0 AND inside) AS DOUBLE), 0), 0) AS hit_in, coalesce(count(*) FILTER (good AND NOT inside) / nullif(CAST(count(*) FILTER (signal <> 0 AND NOT inside) AS DOUBLE), 0), 0) AS hit_out,
  coalesce(abs(coalesce(avg(forward) FILTER (signal = 1 AND forward > 0), 0)) / nullif(abs(coalesce(avg(forward) FILTER (signal = 1 AND NOT forward > 0), 1e-9)), 0), 0) AS payoff_up, coalesce(abs(coalesce(avg(forward) FILTER (signal = -1 AND forward < 0), 0)) / nullif(abs(coalesce(avg(forward) FILTER (signal = -1 AND NOT forward < 0), 1e-9)), 0), 0) AS payoff_down,
  avg(forward) FILTER (signal = 1) AS mu, avg(forward) FILTER (signal = -1) AS md, var_samp(forward) FILTER (signal = 1) / nullif(count(*) FILTER (signal = 1), 0) AS eu, var_samp(forward) FILTER (signal = -1) / nullif(count(*) FILTER (signal = -1), 0) AS ed FROM sp GROUP BY code, rule),
tw AS (SELECT *, CASE WHEN n_up > 1 AND n_down > 1 THEN (mu - md) / nullif(sqrt(eu + ed), 0) END AS t, (eu + ed) * (eu + ed) / nullif(eu * eu / (n_up - 1) + ed * ed / (n_down - 1), 0) AS f FROM te),
be AS (SELECT code, rule, hit FROM te QUALIFY row_number() OVER (PARTITION BY code ORDER BY round(hit, 10) DESC, rank) = 1)"""


def _report(spark, sf_dir):
    bars = panel(spark, sf_dir)
    returns = F.try_divide("vwap", F.nullif(F.lag("vwap").over(Window.partitionBy("code").orderBy("date")), F.lit(0.0))) - 1
    rows = kept(bars.select("code", "date", F.col("vwap").alias("x"), returns.alias("ret")))
    return timing_report.report(rows, "x", "ret", 2, 6, 24, 12, year=12.0)


@query(f"{_ROWS} SELECT code, rule, n_up, n_down, {R('hit', 'hit')}, {R('hit_in', 'hit_in')}, {R('hit_out', 'hit_out')}, {R('payoff_up', 'payoff_up')}, {R('payoff_down', 'payoff_down')}, {R('t', 'welch_t')}, {R('CASE WHEN t IS NOT NULL THEN ' + t_p_sql('t', 'f') + ' END', 'p_value')} FROM tw")
def timing_rule_tests(spark, sf_dir):
    """Seven rules' signals on every supplier's mean price, against the two months that follow, in and out of sample."""
    return neat(_report(spark, sf_dir)[0], "code", "rule", "n_up", "n_down")


@query(f"""{_ROWS}, ps AS (SELECT code, date, coalesce(ret, 0) AS b, coalesce(lag(signal) OVER (PARTITION BY code ORDER BY date), 0) AS p FROM sg JOIN be USING (code, rule)),
pc AS (SELECT *, p * b AS r, CAST(p <> coalesce(lag(p) OVER (PARTITION BY code ORDER BY date), p) AS INTEGER) AS c FROM ps), pn AS (SELECT *, exp(sum(ln(1 + greatest(r, -0.999999))) OVER w) AS nav, sum(c) OVER w AS seg FROM pc WINDOW w AS (PARTITION BY code ORDER BY date)),
pf AS (SELECT *, nav / max(nav) OVER (PARTITION BY code ORDER BY date) - 1 AS fall FROM pn), tr AS (SELECT code, seg, sum(r) + lead(arg_min(r, date)) OVER (PARTITION BY code ORDER BY seg) AS t FROM pn GROUP BY code, seg),
tp AS (SELECT code, avg(CAST(t > 0 AS DOUBLE)) AS tw, avg(t) FILTER (t > 0) / nullif(abs(avg(t) FILTER (t <= 0)), 0) AS po FROM tr WHERE seg > 0 AND t IS NOT NULL GROUP BY code),
ms AS (SELECT code, count(*) AS n, arg_max(nav, date) / arg_min(nav, date) - 1 AS total, avg(r) * 12 AS annual, stddev_samp(r) * sqrt(12) AS volatility, min(fall) AS mdd, avg(CAST(r > 0 AS DOUBLE)) AS hit, sum(c) AS trades, avg(CAST(p <> 0 AS DOUBLE)) AS held, avg(r - b) * 12 AS excess, stddev_samp(r - b) * sqrt(12) AS ev, avg(CAST(r - b > 0 AS DOUBLE)) AS eh FROM pf GROUP BY code)
SELECT code, rule, n, {R('total', 'total')}, {R('annual', 'annual')}, {R('volatility', 'volatility')}, {R('coalesce(annual / nullif(volatility, 0), 0)', 'sharpe')}, {R('mdd', 'max_drawdown')}, {R('coalesce(annual / nullif(-mdd, 0), 0)', 'calmar')}, {R('ms.hit', 'hit')}, CAST(trades AS BIGINT) AS trades,
{R('coalesce(tw, 0)', 'trade_hit')}, {R('coalesce(po, 0)', 'payoff')}, {R('held', 'held')}, {R('excess', 'excess')}, {R('coalesce(excess / nullif(ev, 0), 0)', 'excess_sharpe')}, {R('eh', 'excess_hit')} FROM ms JOIN be USING (code) LEFT JOIN tp USING (code)""")
def timing_measures(spark, sf_dir):
    """The back-test of every supplier's best rule."""
    return neat(_report(spark, sf_dir)[1], "code", "rule", "n", "trades")


@query(f"""{_ROWS}, g0 AS (SELECT code, date, count(*) OVER w AS k, covar_pop(x, forward) OVER w AS c, stddev_pop(x) OVER w * stddev_pop(forward) OVER w AS s FROM t2 WHERE forward IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
ic AS (SELECT code, CASE WHEN k = 12 AND s > 1e-12 THEN c / s END AS ic, row_number() OVER (PARTITION BY code ORDER BY date) <= count(*) OVER (PARTITION BY code) * 0.7 AS inside FROM g0),
st AS (SELECT code, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CAST(ic > 0 AS DOUBLE)) AS hr, avg(ic) FILTER (inside) AS mi, avg(ic) FILTER (NOT inside) AS mo FROM ic GROUP BY code),
rg AS (SELECT code, count(*) AS n, covar_pop(x, forward) * covar_pop(x, forward) / nullif(var_pop(x) * var_pop(forward), 0) AS r2 FROM t2 WHERE forward IS NOT NULL GROUP BY code HAVING count(*) >= 10),
rp AS (SELECT *, {t_p_sql('sqrt(r2 * (n - 2) / nullif(1 - r2, 0))', '(n - 2)')} AS p FROM rg),
pt AS (SELECT code, rule, CASE WHEN abs(coalesce(icir, 0)) >= 2 THEN 0.9 WHEN abs(coalesce(icir, 0)) >= 1 THEN 0.7 WHEN abs(coalesce(icir, 0)) >= 0.5 THEN 0.5 ELSE greatest(0.1, abs(coalesce(icir, 0)) / 2) END * 0.7 + least(coalesce(hr, 0.5), 1) * 0.3 AS a,
  least(1, greatest(0, (coalesce(hit, 0) - 0.3) / 0.4)) AS b, least(1, coalesce(r2, 0) * 10) * 0.5 + CASE WHEN p < 0.05 THEN 0.5 ELSE 0 END AS c,
  CASE WHEN mi IS NULL OR mo IS NULL THEN 0.1 ELSE CASE WHEN sign(mi) = sign(mo) THEN 0.5 ELSE 0 END + coalesce(greatest(0, 0.5 - least(abs(mo - mi) / nullif(abs(mi), 0), 1) * 0.5), 0) END AS d FROM be LEFT JOIN st USING (code) LEFT JOIN rp USING (code)),
sc AS (SELECT *, a * 0.30 + b * 0.25 + c * 0.20 + d * 0.25 AS score FROM pt)
SELECT code, rule, {R('a', 'part_ic')}, {R('b', 'part_signal')}, {R('c', 'part_regression')}, {R('d', 'part_robust')}, {R('score', 'score')}, CASE WHEN round(score, 9) >= 0.8 THEN 'A' WHEN round(score, 9) >= 0.6 THEN 'B' WHEN round(score, 9) >= 0.4 THEN 'C' WHEN round(score, 9) >= 0.2 THEN 'D' ELSE 'F' END AS grade FROM sc""")
def timing_grades(spark, sf_dir):
    """The best rule, the parts of the score and the grade of every supplier's mean price as a timing factor."""
    found = _report(spark, sf_dir)[2]
    return neat(found.select("code", "rule", "part_ic", "part_signal", "part_regression", "part_robust", "score", "grade"), "code", "rule", "grade")
