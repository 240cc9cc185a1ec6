"""Queries of whole factor runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import cross_section, portfolio, profile, run, series, timing
from panelyard.plans.lots import BOOK, LOT_STEPS
from panelyard.plans.portfolio import STATUS
from panelyard.plans.research import NAV, PANEL, SNAPSHOTS, X_SQL, R, _universe, neat, xs
from panelyard.sources.panel import kept, panel

QUERIES: dict = {}
ORACLE_SQL: dict = {}
SPEC = run.Spec(groups=3, long=(2,))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _values(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The cleaned factor of tradable members, and prices; bars are read once."""
    bars = panel(spark, sf_dir, once=True)
    x = bars.select("code", "date", (F.col("volume") / 100.0 + F.col("amount") / 1e6).alias("x"), F.ln("cap").alias("log_cap"), "industry")
    status = bars.select("code", "date", F.when(F.col("volume").isNull(), -1).when((F.col("code") + F.month("date")) % 5 == 0, 0).otherwise(1).alias("status"))
    inside = run.admitted(x, _universe(bars), portfolio.tradable(status))
    return kept(run.preprocessed(inside, "x", SPEC)), bars.select("code", "date", F.col("vwap").alias("price"))


_CLEAN = f"""{PANEL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {SNAPSHOTS}, {STATUS},
x AS MATERIALIZED (SELECT p.code, p.date, volume / 100.0 + amount / 1e6 AS x, ln(cap) AS c, industry FROM panel p JOIN members m ON m.code = p.code AND m.date = p.date JOIN st ON st.code = p.code AND st.date = p.date WHERE status = 1),
md AS (SELECT date, quantile_cont(x, 0.5) AS m FROM x GROUP BY date), sd AS (SELECT date, any_value(m) AS m, quantile_cont(abs(x - m), 0.5) AS s FROM x JOIN md USING (date) GROUP BY date),
cp AS (SELECT code, date, c, industry, x AS raw, greatest(least(x, m + 3 * s), m - 3 * s) AS x FROM x JOIN sd USING (date)), z AS (SELECT code, date, c, industry, raw, coalesce((x - avg(x) OVER d) / nullif(stddev_samp(x) OVER d, 0), 0) AS x FROM cp WINDOW d AS (PARTITION BY date)),
u AS (SELECT *, coalesce(CAST(industry AS VARCHAR), min(CAST(industry AS VARCHAR)) OVER (PARTITION BY date), '') AS g FROM z), dm AS (SELECT *, x - avg(x) OVER (PARTITION BY date, g) AS y, c - avg(c) OVER (PARTITION BY date, g) AS q FROM u),
b AS (SELECT date, sum(y * q) / nullif(sum(q * q), 0) AS b, count(*) AS n, count(DISTINCT g) + 1 AS k FROM dm GROUP BY date),
cl AS MATERIALIZED (SELECT code, date, c, industry, raw, round(CASE WHEN n < k + 5 THEN x ELSE y - coalesce(b, 0) * q END, 10) AS x FROM dm JOIN b USING (date))"""
_TRADED = f"""{_CLEAN}, eg AS (SELECT date, list_distinct(quantile_cont(x, [0, {1 / 3}, {2 / 3}, 1])) AS e FROM cl GROUP BY date),
lb AS (SELECT code, date, greatest(0, len(list_filter(e, lambda v: v < x)) - 1) AS label FROM cl JOIN eg USING (date) WHERE len(e) > 1), tg AS (SELECT code, date, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM lb WHERE label = 2),
rd AS (SELECT DISTINCT date FROM tg), pw AS MATERIALIZED (SELECT 'run' AS portfolio, p.date, p.code, vwap AS price, coalesce(weight, 0) AS weight FROM panel p JOIN rd USING (date) LEFT JOIN tg ON tg.code = p.code AND tg.date = p.date WHERE vwap > 0), {LOT_STEPS}, {BOOK}"""


def _cleaned_book(spark, sf_dir) -> DataFrame:
    values, prices = _values(spark, sf_dir)
    lots = kept(run.traded(run.targets(values, SPEC), prices, SPEC))
    return run.book(lots, prices, SPEC)


@query(f"{_TRADED} SELECT date, {R('value', 'value')}, {R('cash / nullif(value + cash, 0)', 'cash_share')}, {R('(value + cash) / a', 'nav')} FROM bk")
def run_book(spark, sf_dir):
    """Universe, tradability, cleaning, groups, whole lots and value, bar by bar."""
    found = _cleaned_book(spark, sf_dir)
    return neat(found.withColumn("cash_share", F.try_divide("cash", F.nullif(F.col("value") + F.col("cash"), F.lit(0.0)))).drop("cash", "portfolio"), "date")


@query(_TRADED + ", nav AS (SELECT portfolio AS code, date, (value + cash) / a AS nav FROM bk), " + NAV[NAV.index("r AS (SELECT *, nav / lag") :] + f""" SELECT n, {R('total', 'total')}, {R('annual', 'annual')}, {R('std * y', 'volatility')}, {R('mean / nullif(std, 0) * y', 'sharpe')}, {R('mdd', 'max_drawdown')}, {R('annual / nullif(-mdd, 0)', 'calmar')}, {R('ulcer', 'ulcer')},
CAST(longest AS BIGINT) AS longest_drawdown, {R('mean / nullif(down, 0) * y', 'sortino')}, {R('q', 'var_5')}, {R('cvar', 'cvar_5')}, {R('win', 'win_rate')}, {R('payoff', 'payoff')} FROM s""")
def run_summary(spark, sf_dir):
    """The measures of the whole run."""
    found = series.summary(kept(_cleaned_book(spark, sf_dir).select("portfolio", "date", "nav")), "nav", "portfolio")
    columns = ["n", "total", "annual", "volatility", "sharpe", "max_drawdown", "calmar", "ulcer", "longest_drawdown", "sortino", "var_5", "cvar_5", "win_rate", "payoff"]
    return neat(found.select(*columns), "n", "longest_drawdown").select(*columns)


@query(f"""{_CLEAN}, sc AS (SELECT *, (raw - avg(raw) OVER d) / nullif(stddev_samp(raw) OVER d, 0) AS r FROM cl WINDOW d AS (PARTITION BY date)),
gm AS (SELECT date, avg(abs(a)) AS group_raw, avg(abs(b)) AS "group" FROM (SELECT date, industry, avg(r) AS a, avg(x) AS b FROM sc WHERE industry IS NOT NULL GROUP BY 1, 2) GROUP BY date),
co AS (SELECT date, count(*) AS n, CASE WHEN stddev_pop(r) * stddev_pop(c) > 1e-12 THEN covar_pop(r, c) / (stddev_pop(r) * stddev_pop(c)) END AS corr_raw, CASE WHEN stddev_pop(x) * stddev_pop(c) > 1e-12 THEN covar_pop(x, c) / (stddev_pop(x) * stddev_pop(c)) END AS corr FROM sc GROUP BY date)
SELECT date, n, {R('corr_raw', 'corr_raw')}, {R('corr', 'corr')}, {R('group_raw', 'group_raw')}, {R('"group"', '"group"')} FROM co LEFT JOIN gm USING (date)""")
def run_diagnostics(spark, sf_dir):
    """What cleaning did to the factor on each date."""
    values, _ = _values(spark, sf_dir)
    return neat(run.diagnostics(values, "x", "industry", "log_cap"), "date", "n")


@query(f"""{PANEL}, {X_SQL}, f AS (SELECT * FROM x WHERE x IS NOT NULL AND returns IS NOT NULL), e1 AS (SELECT date, list_distinct(quantile_cont(x, [0, {1 / 3}, {2 / 3}, 1])) AS e FROM f GROUP BY date), e2 AS (SELECT date, list_distinct(quantile_cont(returns, [0, {1 / 3}, {2 / 3}, 1])) AS e FROM f GROUP BY date),
l AS (SELECT code, f.date, greatest(0, len(list_filter(e1.e, lambda v: v < x)) - 1) AS a, greatest(0, len(list_filter(e2.e, lambda v: v < returns)) - 1) AS b FROM f JOIN e1 USING (date) JOIN e2 USING (date)),
s AS (SELECT code, date, CASE WHEN (a, b) IN ((2, 0), (2, 1)) THEN 1 WHEN (a, b) IN ((0, 2)) THEN -1 ELSE 0 END AS s FROM l) SELECT code, date, {R('s * 1.0 / count(*) OVER (PARTITION BY date, s)', 'weight')} FROM s QUALIFY s <> 0""")
def given_combinations(spark, sf_dir):
    """Weights of given pairs of labels: large factor with small or middle returns against small factor with large ones."""
    rows = xs(spark, sf_dir).where("x IS NOT NULL AND returns IS NOT NULL")
    labelled = cross_section.double_sort(rows, "x", "returns", 3, 3)
    return neat(run.chosen_weights(labelled, ["label_1", "label_2"], [(2, 0), (2, 1)], [(0, 2)]).where("weight <> 0").select("code", "date", "weight"), "code", "date")


@query(f"""{PANEL}, {SNAPSHOTS}, {X_SQL}, ad AS (SELECT x.* FROM x WHERE x IS NOT NULL AND (code = 1 OR EXISTS (SELECT 1 FROM members m WHERE m.code = x.code AND m.date = x.date))), rk AS (SELECT code, date, round((rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) / count(*) OVER (PARTITION BY date), 10) AS x FROM ad),
th AS (SELECT code, date, x, count(*) OVER w AS k, avg(x) OVER w + 0.5 * stddev_samp(x) OVER w AS edge FROM rk WHERE code = 1 WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
wt AS (SELECT date, CASE WHEN k = 12 AND x > edge THEN 1.0 ELSE 0 END AS weight FROM th), rt AS (SELECT date, returns, lead(date) OVER (ORDER BY date) AS nx FROM panel WHERE code = 1),
jn AS (SELECT p.date, returns, weight, lag(weight) OVER (ORDER BY p.date) AS held FROM rt p LEFT JOIN wt USING (date))
SELECT date, {R('coalesce(weight, 0)', 'weight')}, {R('exp(sum(ln(1 + greatest(coalesce(held, 0) * coalesce(returns, 0), -0.999999))) OVER (ORDER BY date))', 'nav')} FROM jn""")
def single_name_run(spark, sf_dir):
    """One code's timing by its rank in the cross-section of the universe, into which it always comes."""
    bars = panel(spark, sf_dir, once=True)
    x = bars.select("code", "date", (F.col("volume") / 100.0 + F.col("amount") / 1e6).alias("x")).where("x IS NOT NULL")
    ranked = cross_section.standardize(run.admitted(x, _universe(bars), always=(1,)), "x", "rank").withColumn("x", F.round("x", 10)).where("code = 1")
    weights = timing.rolling_threshold(ranked, "x", 12, 0.5).select("date", "weight")
    w = Window.partitionBy("code").orderBy("date")
    one = bars.where("code = 1").select("code", "date", "returns").join(weights, "date", "left").withColumn("held", F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    grown = series.cumulative(one.withColumn("ret", F.greatest(F.col("held") * F.coalesce("returns", F.lit(0.0)), F.lit(-0.999999))))
    return neat(grown.select("date", F.coalesce("weight", F.lit(0.0)).alias("weight"), "nav"), "date")


_BINS = f"""{PANEL}, pv AS (SELECT vwap AS v FROM panel WHERE vwap IS NOT NULL), sn AS (SELECT min(v) AS a, max(v) AS b, max(abs(v)) AS c, count(*) AS n FROM pv),
bt AS (SELECT n, 'x' AS side, v, a AS low, (b - a) / 256 AS width FROM pv, sn UNION ALL SELECT n, 'size', abs(v), 0, c / 256 FROM pv, sn),
bn AS MATERIALIZED (SELECT side, CAST(least(255, floor((v - low) / width)) AS INTEGER) AS bin, low, width, n, count(*) AS k, sum(v) AS total FROM bt GROUP BY ALL), cm AS (SELECT *, sum(k) OVER (PARTITION BY side ORDER BY bin) AS after, sum(k) OVER (PARTITION BY side ORDER BY bin DESC) - k AS before FROM bn)"""


def _binned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    prices = kept(panel(spark, sf_dir).select("vwap"))
    return prices, profile.bins(prices, "vwap", 256)


@query(f"{_BINS} SELECT {R('low + (bin + 1) * width', 'value')}, {R('after / n', 'probability')} FROM cm WHERE side = 'x'")
def profile_distribution(spark, sf_dir):
    """The distribution of mean prices, thinned to at most 256 points."""
    return neat(profile.distribution(_binned(spark, sf_dir)[1]))


@query(f"{_BINS} SELECT q AS quantile, {R('low + (bin + (q * n - (after - k)) / k) * width', 'value')} FROM cm, (SELECT unnest([{', '.join(map(str, (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)))}]::DOUBLE[]) AS q) WHERE side = 'x' AND q * n > after - k AND q * n <= after")
def profile_quantiles(spark, sf_dir):
    return neat(profile.quantiles(_binned(spark, sf_dir)[1]), "quantile")


@query(f"""{_BINS}, tk AS (SELECT sum(greatest(0, least(k, greatest(1, ceil(n * 0.1)) - before)) * total / k) / sum(total) AS top_share FROM cm WHERE side = 'size')
SELECT count(vwap) AS count, count(*) - count(vwap) AS missing, {R('avg(vwap)', 'mean')}, {R('stddev_samp(vwap)', 'std')}, {R('sum(vwap * vwap) / (sum(abs(vwap)) * sum(abs(vwap)))', 'hhi')}, {R('(SELECT top_share FROM tk)', 'top_share')} FROM panel""")
def profile_summary(spark, sf_dir):
    prices, binned = _binned(spark, sf_dir)
    return neat(profile.concentration(prices, binned, "vwap"), "count", "missing")
