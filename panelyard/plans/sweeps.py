"""Queries of sweeps, bootstrap tests and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import selection, tables
from panelyard.plans.formulas import rounded_sql
from panelyard.plans.research import BASE, LABELS, NAV, PANEL, WEIGHTS, X_SQL, R, forward, navs, neat, weighted
from panelyard.sources.panel import load, panel

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CAL = "cal AS (SELECT d AS date, row_number() OVER (ORDER BY d) - 1 AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem))"


def _calendar(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


@query(f"WITH {CAL} SELECT CAST(a.n / 60 AS INTEGER) AS \"window\", a.date AS start, b.date AS \"end\" FROM cal a JOIN cal b ON b.n = a.n + 249 WHERE a.n % 60 = 0")
def sweep_windows(spark, sf_dir):
    return selection.rolling_windows(_calendar(spark, sf_dir), 250, 60)


@query(f"""WITH {CAL} SELECT CAST(a.n / 60 AS INTEGER) AS "window", a.date AS train_start, b.date AS train_end, c.date AS test_start, d.date AS test_end
FROM cal a JOIN cal b ON b.n = a.n + 249 JOIN cal c ON c.n = a.n + 250 JOIN cal d ON d.n = a.n + 309 WHERE a.n % 60 = 0""")
def walk_forward_windows(spark, sf_dir):
    return selection.train_test_windows(_calendar(spark, sf_dir), 250, 60)


YEARLY = 'cand AS (SELECT code AS gid, year(date) AS "window", round(avg(returns), 9) AS score, round(-stddev_samp(returns), 9) AS calm, count(returns) AS n FROM panel GROUP BY 1, 2)'


def _candidates(spark, sf_dir):
    """Each supplier's year as a candidate: mean return, and deviation with its sign turned."""
    return panel(spark, sf_dir).groupBy(F.col("code").alias("gid"), F.year("date").alias("window")).agg(F.round(F.avg("returns"), 9).alias("score"), F.round(-F.stddev_samp("returns"), 9).alias("calm"), F.count("returns").alias("n"))


@query(f"""{PANEL}, {YEARLY}, b AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY score DESC, gid) AS k FROM cand WHERE score IS NOT NULL) SELECT CAST("window" AS INTEGER) AS "window", gid, {R('score', 'score')} FROM b WHERE k = 1""")
def sweep_champions(spark, sf_dir):
    return neat(selection.champions(_candidates(spark, sf_dir), "score"), "window")


@query(f"""{PANEL}, {YEARLY}, b AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY score DESC, gid) AS k FROM cand WHERE score IS NOT NULL) SELECT gid, count(*) AS wins, {R('avg(score)', 'mean_score')} FROM b WHERE k = 1 GROUP BY gid""")
def sweep_wins(spark, sf_dir):
    return neat(selection.wins(selection.champions(_candidates(spark, sf_dir), "score"), "score"), "gid")


@query(f"""{PANEL}, {YEARLY}, v AS (SELECT * FROM cand WHERE score IS NOT NULL AND calm IS NOT NULL) SELECT gid, CAST("window" AS INTEGER) AS "window", {R('score', 'score')}, {R('calm', 'calm')} FROM v
WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.score >= v.score AND o.calm >= v.calm AND (o.score > v.score OR o.calm > v.calm))""")
def sweep_pareto_front(spark, sf_dir):
    return neat(selection.pareto_front(_candidates(spark, sf_dir).drop("n"), "score", "calm"), "gid", "window")


@query(f"""{PANEL}, {YEARLY}, b AS (SELECT gid, "window", greatest(0, 10 - n) / 10.0 + greatest(0, -calm - 1.5) / 1.5 AS v FROM cand) SELECT gid, CAST("window" AS INTEGER) AS "window", {R('v', 'violation')} FROM b""")
def sweep_violations(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("spread", -F.col("calm"))
    return neat(c.select("gid", "window", selection.violation({"n": ("min", 10.0), "spread": ("max", 1.5)}).alias("violation")), "gid", "window")


@query(f"""{PANEL}, {YEARLY}, t AS (SELECT gid, avg(score) AS score FROM cand GROUP BY gid), b AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC NULLS LAST, gid) AS place, count(*) OVER () AS n FROM t)
SELECT gid, {R('round(score, 9)', 'score')}, CAST(place AS INTEGER) AS place FROM b WHERE place <= greatest(3, n // 4) OR gid = 1""")
def sweep_survivors(spark, sf_dir):
    mean = _candidates(spark, sf_dir).groupBy("gid").agg(F.round(F.avg("score"), 9).alias("score"))
    return neat(selection.survivors(mean, "score", 4, 3, always=(1,)), "gid")


@query(f"""{NAV}, p AS (SELECT code FROM (SELECT code, max(abs(nav)) AS p FROM nav GROUP BY code) ORDER BY p DESC, code LIMIT 5) SELECT code, date, nav FROM nav SEMI JOIN p USING (code)""")
def leading_codes(spark, sf_dir):
    return tables.leading(navs(spark, sf_dir), "nav", 5)


@query(f"""{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, k AS (SELECT date, code, weight, row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, code) AS n FROM weights WHERE weight <> 0)
SELECT date, CASE WHEN n <= 3 THEN CAST(code AS VARCHAR) ELSE 'other' END AS code, {R('sum(weight)', 'weight')} FROM k GROUP BY 1, 2""")
def daily_holdings(spark, sf_dir):
    return neat(tables.daily_holdings(weighted(spark, sf_dir).select("date", "code", "weight"), 3), "date", "code")


@query(f"""{NAV}, h(h) AS (VALUES (1), (3), (5)), f AS (SELECT code, date, nav, [lead(nav, 1) OVER w, lead(nav, 3) OVER w, lead(nav, 5) OVER w] AS l FROM nav WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, CAST(h AS INTEGER) AS horizon, {R('l[CASE h WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END] / nav - 1', 'ret')} FROM f, h WHERE l[CASE h WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END] IS NOT NULL""")
def forward_return_table(spark, sf_dir):
    return neat(tables.forward_returns(navs(spark, sf_dir), "nav", [1, 3, 5]), "code", "date", "horizon")


@query(f"""{BASE}, e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 12 AS w FROM f), b AS (SELECT CAST(least(11, floor((x - lo) / w)) AS INTEGER) AS bin, lo, w FROM f, e WHERE x IS NOT NULL)
SELECT bin, {rounded_sql('any_value(lo) + bin * any_value(w)')} AS low, {rounded_sql('any_value(lo) + (bin + 1) * any_value(w)')} AS high, count(*) AS n FROM b GROUP BY bin""")
def factor_histogram(spark, sf_dir):
    return neat(tables.histogram(forward(spark, sf_dir), "x", 12), "bin")
