"""Queries of signal tests, profiles, event tables and repairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import backtest, cross_section, evaluation, events, portfolio, quality, selection, signals, timing
from panelyard.operators.asof import in_universe
from panelyard.plans.access import RAW, raw
from panelyard.plans.inference import t_p_sql
from panelyard.plans.research import BASE, IC, LABELS, PANEL, SNAPSHOTS, WEIGHTS, X_SQL, R, _rules_sql, _universe, forward, neat, weighted, xs
from panelyard.plans.sweeps import YEARLY, _candidates
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


@query(f"""{PANEL}, {X_SQL}, f AS (SELECT code, date, x, CASE WHEN count(returns) OVER w = 3 THEN sum(returns) OVER w END AS f FROM x WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
g AS (SELECT code, date, count(*) OVER w AS k, covar_pop(x, f) OVER w AS c, stddev_pop(x) OVER w * stddev_pop(f) OVER w AS s FROM f WHERE x IS NOT NULL AND f IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT code, date, {R('CASE WHEN k = 12 AND s > 1e-12 THEN c / s END', 'ic')} FROM g""")
def timing_ic(spark, sf_dir):
    return neat(signals.timing_ic(xs(spark, sf_dir), "x", "returns", 3, 12), "code", "date")


SIG = f"""sg AS (SELECT code, date, returns AS x, CAST(sign(lag(returns) OVER (PARTITION BY code ORDER BY date)) AS INTEGER) AS signal FROM panel WHERE returns IS NOT NULL),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY date) <= count(*) OVER (PARTITION BY code) * 0.7 THEN 'in' ELSE 'out' END AS sample FROM sg)"""


def _test_sql(by: str, source: str) -> str:
    return f"""a AS (SELECT {by}, count(*) FILTER (signal > 0) AS nu, count(*) FILTER (signal < 0) AS nd, count(*) FILTER (signal > 0 AND x > 0) AS hu, count(*) FILTER (signal < 0 AND x < 0) AS hd, avg(x) FILTER (signal > 0) AS mu, avg(x) FILTER (signal < 0) AS md,
var_samp(x) FILTER (signal > 0) AS vu, var_samp(x) FILTER (signal < 0) AS vd FROM {source} WHERE signal IS NOT NULL GROUP BY {by})
SELECT {by}, nu AS n_up, nd AS n_down, {R('hu / nullif(CAST(nu AS DOUBLE), 0)', 'hit_up')}, {R('hd / nullif(CAST(nd AS DOUBLE), 0)', 'hit_down')}, {R('(hu + hd) / nullif(CAST(nu + nd AS DOUBLE), 0)', 'hit')}, {R('mu', 'mean_up')}, {R('md', 'mean_down')}, {R('mu - md', 'spread')}, {R('(mu - md) / nullif(sqrt(vu / nullif(nu, 0) + vd / nullif(nd, 0)), 0)', 'welch_t')} FROM a"""


def _signals(spark, sf_dir) -> DataFrame:
    before = F.lag("returns").over(Window.partitionBy("code").orderBy("date"))
    return panel(spark, sf_dir).where("returns is not null").select("code", "date", F.col("returns").alias("x"), F.signum(before).cast("int").alias("signal"))


@query(f"{PANEL}, {SIG}, {_test_sql('code', 'sg')}")
def signal_test(spark, sf_dir):
    return neat(signals.signal_test(_signals(spark, sf_dir), "signal", "x", ["code"]), "code", "n_up", "n_down")


@query(f"{PANEL}, {SIG}, {_test_sql('code, sample', 'sp')}")
def signal_test_by_sample(spark, sf_dir):
    return neat(signals.signal_test(signals.split(_signals(spark, sf_dir), 0.7), "signal", "x", ["code", "sample"]), "code", "sample", "n_up", "n_down")


REGRESSION = """b AS (SELECT {by}, count(*) AS n, covar_samp(x, y) AS c, var_samp(x) AS vx, var_samp(y) AS vy, avg(x) AS mx, avg(y) AS my FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY {by} HAVING count(*) >= {least}),
d AS (SELECT *, c / nullif(vx, 0) AS beta, c * c / nullif(vx * vy, 0) AS r2 FROM b), e AS (SELECT *, r2 * (n - 2) / nullif(1 - r2, 0) AS f FROM d)"""


@query(f"""{PANEL}, {X_SQL}, y AS (SELECT code, x, lead(returns) OVER (PARTITION BY code ORDER BY date) AS y FROM x), {REGRESSION.format(by='code', source='y', least=10)}
SELECT code, n, {R('my - beta * mx', 'alpha')}, {R('beta', 'beta')}, {R('sign(beta) * sqrt(f)', 't')}, {R('r2', 'r2')}, {R('1 - (1 - r2) * (n - 1) / (n - 2)', 'adj_r2')}, {R('f', 'f')} FROM e""")
def timing_regression(spark, sf_dir):
    ahead = xs(spark, sf_dir).withColumn("y", F.lead("returns").over(Window.partitionBy("code").orderBy("date")))
    return neat(signals.regression(ahead, "y", "x", ["code"]), "code", "n")


@query(f"""WITH r AS ({_rules_sql()}), {PANEL.removeprefix('WITH ')}, j AS (SELECT r.code, r.rule, r.date, signal, coalesce(returns, 0) AS ret FROM r JOIN panel p ON p.code = r.code AND p.date = r.date),
p1 AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY code, rule ORDER BY date), 0) AS p FROM j), p2 AS (SELECT *, p * ret AS g, CAST(p <> coalesce(lag(p) OVER (PARTITION BY code, rule ORDER BY date), 0) AS INTEGER) AS c FROM p1)
SELECT code, rule, {R('exp(sum(ln(1 + greatest(g, -0.999999)))) - 1', 'total')}, count(*) FILTER (p <> 0) AS days_in, {R('count(*) FILTER (g > 0) / nullif(CAST(count(*) FILTER (p <> 0) AS DOUBLE), 0)', 'hit_rate')}, CAST(sum(c) AS BIGINT) AS changes FROM p2 GROUP BY code, rule""")
def signal_backtests(spark, sf_dir):
    bars = panel(spark, sf_dir)
    ruled = timing.rule_signals(bars, "returns").join(bars.select("code", "date", "returns"), ["code", "date"])
    return neat(timing.signal_backtest(ruled, "signal", "returns", ("code", "rule")), "code", "rule", "days_in", "changes")


@query(f"""{BASE}, m AS (SELECT year(date) AS year, label, avg(forward) AS m FROM f WHERE label IS NOT NULL AND forward IS NOT NULL GROUP BY 1, 2), r AS (SELECT year, label, rank() OVER (PARTITION BY year ORDER BY m) + (count(*) OVER (PARTITION BY year, m) - 1) / 2.0 AS r FROM m),
c AS (SELECT year, count(*) AS groups, covar_pop(label, r) / nullif(stddev_pop(label) * stddev_pop(r), 0) AS rho FROM r GROUP BY year) SELECT CAST(year AS INTEGER) AS year, groups, {R('rho', 'rho')}, abs(rho) > 0.8 AS monotone FROM c""")
def monotonicity(spark, sf_dir):
    return neat(signals.monotonicity(forward(spark, sf_dir).withColumn("year", F.year("date")), "label", "forward", ["year"]), "year", "groups")


@query(f"""{PANEL}, {X_SQL}, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY round(x, 10), code) AS DOUBLE) AS r FROM x WHERE x IS NOT NULL), e AS (SELECT date, list_distinct(quantile_cont(r, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM rk GROUP BY date)
SELECT code, date, CAST(CASE WHEN len(e) > 1 THEN greatest(0, len(list_filter(e, lambda q: q < r)) - 1) END AS INTEGER) AS label FROM rk JOIN e USING (date)""")
def ranked_groups(spark, sf_dir):
    return signals.ranked_groups(xs(spark, sf_dir), "x", 5).select("code", "date", "label")


@query(f"{BASE}, {IC}, m AS (SELECT avg(ic) AS ic FROM ic GROUP BY date_trunc('month', date) HAVING avg(ic) IS NOT NULL), q AS (SELECT quantile_cont(ic, 0.5) AS q FROM m) SELECT count(*) AS months, {R('any_value(q)', 'median')}, {R('any_value(q) - 0.25 * 1.4826 * quantile_cont(abs(ic - q), 0.5)', 'robust')} FROM m, q")
def robust_ic(spark, sf_dir):
    return neat(signals.robust_ic(evaluation.information_coefficient(forward(spark, sf_dir), "x", "forward")), "months")


@query(f"{PANEL}, {X_SQL}, m AS (SELECT date, quantile_cont(x, 0.5) AS m FROM x GROUP BY date), d AS (SELECT date, quantile_cont(abs(x - m), 0.5) AS d FROM x JOIN m USING (date) GROUP BY date) SELECT date, count(*) AS n, count(*) FILTER (round(abs(x - m) - 3 * d, 9) > 0) AS outside, {R('count(*) FILTER (round(abs(x - m) - 3 * d, 9) > 0) / CAST(count(*) AS DOUBLE)', 'share')} FROM x JOIN m USING (date) JOIN d USING (date) WHERE x IS NOT NULL GROUP BY date")
def outlier_report(spark, sf_dir):
    return neat(signals.outliers(xs(spark, sf_dir), "x", 3.0), "date", "n", "outside")


FACTORS = ["x", "returns", "cap"]
PAIRS = f"""{PANEL}, {X_SQL}, pr AS (SELECT date, code, 'x' AS a, 'returns' AS b, x, returns AS y FROM x UNION ALL SELECT date, code, 'x', 'cap', x, cap FROM x UNION ALL SELECT date, code, 'returns', 'cap', returns, cap FROM x), ok AS (SELECT * FROM pr WHERE x IS NOT NULL AND y IS NOT NULL)"""
RANKED = f"""{PAIRS}, rr AS (SELECT date, a, b, (rank() OVER (PARTITION BY date, a, b ORDER BY x) + (count(*) OVER (PARTITION BY date, a, b, x) - 1) / 2.0) AS u, (rank() OVER (PARTITION BY date, a, b ORDER BY y) + (count(*) OVER (PARTITION BY date, a, b, y) - 1) / 2.0) AS v FROM ok),
rc AS (SELECT date, a, b, covar_pop(u, v) / nullif(stddev_pop(u) * stddev_pop(v), 0) AS c FROM rr GROUP BY date, a, b HAVING count(*) >= 5), cm AS (SELECT a, b, count(c) AS n, avg(c) AS mean FROM rc GROUP BY a, b)"""


@query(f"{RANKED} SELECT a, b, n, {R('mean', 'mean')} FROM cm")
def factor_correlations(spark, sf_dir):
    return neat(evaluation.factor_correlations(xs(spark, sf_dir), FACTORS), "a", "b", "n")


@query(f"{PAIRS} SELECT date, a, b, count(*) AS n, {R('CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END', 'corr')} FROM ok GROUP BY date, a, b HAVING count(*) >= 5")
def pair_correlation_series(spark, sf_dir):
    return neat(signals.pair_correlations(xs(spark, sf_dir), FACTORS), "date", "a", "b", "n")


@query(f"""{PANEL}, {X_SQL}, lf AS (SELECT date, code, unnest(['x', 'returns', 'cap']) AS factor, unnest([x, returns, cap]) AS v FROM x), q AS (SELECT date, factor, quantile_cont(v, 0.8) AS q FROM lf GROUP BY date, factor), ch AS (SELECT lf.date, code, lf.factor FROM lf JOIN q ON q.date = lf.date AND q.factor = lf.factor WHERE v >= q),
sz AS (SELECT date, factor, count(*) AS n FROM ch GROUP BY date, factor), prs(a, b) AS (VALUES ('x', 'returns'), ('x', 'cap'), ('returns', 'cap')), cn AS (SELECT u.date, a, b, count(w.code) AS k FROM prs JOIN ch u ON u.factor = a LEFT JOIN ch w ON w.factor = b AND w.date = u.date AND w.code = u.code GROUP BY u.date, a, b)
SELECT a, b, count(*) AS dates, {R('avg(k / CAST(p.n + s.n - k AS DOUBLE))', 'jaccard')} FROM cn JOIN sz p ON p.date = cn.date AND p.factor = a JOIN sz s ON s.date = cn.date AND s.factor = b GROUP BY a, b""")
def selection_coincidence(spark, sf_dir):
    return neat(signals.selection_coincidence(xs(spark, sf_dir), FACTORS), "a", "b", "dates")


@query(f"""WITH RECURSIVE {RANKED.removeprefix('WITH ')}, nr AS (SELECT a, b FROM cm WHERE abs(mean) >= 0.02), lk AS (SELECT a, b FROM nr UNION ALL SELECT b, a FROM nr), fs(f) AS (VALUES ('x'), ('returns'), ('cap')), rch AS (SELECT f AS factor, f AS l FROM fs UNION SELECT rch.factor, lk.b FROM rch JOIN lk ON lk.a = rch.l) SELECT factor, min(l) AS leader FROM rch GROUP BY factor""")
def redundant_factors(spark, sf_dir):
    found = evaluation.factor_correlations(xs(spark, sf_dir), FACTORS)
    names = spark.createDataFrame([(f,) for f in FACTORS], "factor string")
    return signals.redundant_groups(found, names, 0.02, len(FACTORS))


@query(f"{PANEL} SELECT code, date, CASE WHEN returns > 0.1 THEN 0.8 ELSE 0.0 END AS weight, CAST(date AS TIMESTAMP) + INTERVAL 10 MINUTE AS execute_at FROM panel")
def threshold_weights(spark, sf_dir):
    return signals.threshold_weights(panel(spark, sf_dir), "returns", 0.1, True, 1, 0.8).select("code", "date", "weight", "execute_at")


@query(f"""{PANEL}, mk AS (SELECT date, avg(returns) AS y FROM panel GROUP BY date), fc AS (SELECT p.code, x, y FROM (SELECT code, date, lag(returns) OVER (PARTITION BY code ORDER BY date) AS x FROM panel) p JOIN mk USING (date)), {REGRESSION.format(by='code', source='fc', least=3)} SELECT code, n, {R('beta', 'beta')}, {R('sqrt(f)', 'abs_t')} FROM e""")
def single_factor_tests(spark, sf_dir):
    bars = panel(spark, sf_dir)
    market = bars.groupBy("date").agg(F.avg("returns").alias("y"))
    return neat(signals.single_factor_tests(bars.withColumn("x", F.lag("returns").over(Window.partitionBy("code").orderBy("date"))).join(market, "date"), "y", "x", "code"), "code", "n")


@query(f"""{PANEL}, {X_SQL}, h AS (SELECT code, date, x, unnest([1, 3, 6]) AS horizon, unnest([lead(close, 1) OVER w, lead(close, 3) OVER w, lead(close, 6) OVER w]) / nullif(close, 0) - 1 AS forward FROM x WINDOW w AS (PARTITION BY code ORDER BY date)), p AS (SELECT * FROM h WHERE x IS NOT NULL AND forward IS NOT NULL),
r AS (SELECT horizon, date, (rank() OVER (PARTITION BY horizon, date ORDER BY x) + (count(*) OVER (PARTITION BY horizon, date, x) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY horizon, date ORDER BY forward) + (count(*) OVER (PARTITION BY horizon, date, forward) - 1) / 2.0) AS b FROM p),
c AS (SELECT horizon, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM r GROUP BY horizon, date HAVING count(*) >= 5)
SELECT horizon, count(ic) AS n, {R('avg(ic)', 'mean')}, {R('stddev_samp(ic)', 'std')}, {R('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')} FROM c GROUP BY horizon""")
def ic_by_horizon(spark, sf_dir):
    rows = signals.horizons(xs(spark, sf_dir), "close", [1, 3, 6]).withColumn("key", F.struct("horizon", "date"))
    ic = evaluation.information_coefficient(rows, "x", "forward", date="key").withColumn("horizon", F.col("key.horizon"))
    return neat(evaluation.ic_summary(ic, ("horizon",)).select("horizon", "n", "mean", "std", "icir"), "horizon", "n")


# ---- events ------------------------------------------------------------------------------------------------------

MANY = """px AS (SELECT event_type AS code, CAST(ts AS DATE) AS date, sum(value) + 1 AS price FROM events GROUP BY 1, 2), bar AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS bar, price / nullif(lag(price) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM px),
ev AS (SELECT DISTINCT event_type AS code, strftime(ts, '%Y-%m-%d') AS event_id, CAST(ts AS DATE) AS due FROM events), zero AS (SELECT ev.code, event_id, min(bar) AS zero FROM ev JOIN bar ON bar.code = ev.code AND bar.date >= due GROUP BY ev.code, event_id),
win AS (SELECT z.code, event_id, CAST(b.bar - zero AS INTEGER) AS day, ret FROM zero z JOIN bar b ON b.code = z.code AND b.bar BETWEEN zero - 3 AND zero + 5)"""


def _many(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each day is an event of every type that occurs on it."""
    e = load(spark, sf_dir, "events")
    prices = e.groupBy(F.col("event_type").alias("code"), F.to_date("ts").alias("date")).agg((F.sum("value") + 1).alias("price"))
    days = prices.select("code", F.date_format("date", "yyyy-MM-dd").alias("event_id"), F.to_timestamp("date").alias("event_ts"))
    return days, events.window_returns(days, prices, 3, 5)


@query(f"WITH {MANY} SELECT event_id, day, {R('avg(ret)', 'ret')}, count(ret) AS codes FROM win GROUP BY event_id, day")
def event_day_matrix(spark, sf_dir):
    return neat(events.by_event(_many(spark, sf_dir)[1]), "event_id", "day", "codes")


@query(f"WITH {MANY}, b AS (SELECT event_id, day, avg(ret) AS b FROM win GROUP BY event_id, day) SELECT code, event_id, day, {R('ret - b', 'ret')} FROM win JOIN b USING (event_id, day)")
def event_adjusted_returns(spark, sf_dir):
    rows = _many(spark, sf_dir)[1]
    return neat(events.adjusted(rows, rows).select("code", "event_id", "day", "ret"), "code", "event_id", "day")


OFFSETS = {"-3d": -3, "-1d": -1, "1d": 1, "3d": 3, "5d": 5}
FIXED = f"""{MANY}, g AS (SELECT *, ln(1 + coalesce(ret, 0)) AS g FROM win), cu AS (SELECT code, event_id, day, exp(CASE WHEN day >= 0 THEN sum(CASE WHEN day >= 0 THEN g END) OVER (PARTITION BY code, event_id ORDER BY day) ELSE sum(CASE WHEN day <= 0 THEN g END) OVER (PARTITION BY code, event_id ORDER BY day DESC) END) - 1 AS cumulative FROM g),
fx AS (SELECT code, event_id, day || 'd' AS period, cumulative FROM cu WHERE day IN (-3, -1, 1, 3, 5))"""


@query(f"WITH {FIXED} SELECT code, event_id, period, {R('cumulative', 'cumulative')} FROM fx")
def event_fixed_returns(spark, sf_dir):
    return neat(events.at_offsets(_many(spark, sf_dir)[1], OFFSETS), "code", "event_id", "period")


@query(f"WITH {FIXED} SELECT period, count(cumulative) AS n, {R('avg(cumulative)', 'mean')}, {R('stddev_samp(cumulative)', 'std')}, {R('count(*) FILTER (cumulative > 0) / CAST(count(cumulative) AS DOUBLE)', 'p_up')} FROM fx GROUP BY period")
def event_period_statistics(spark, sf_dir):
    return neat(events.period_statistics(events.at_offsets(_many(spark, sf_dir)[1], OFFSETS)).select("period", "n", "mean", "std", "p_up"), "period", "n")


@query(f"WITH {MANY}, e AS (SELECT code, count(DISTINCT event_id) AS events FROM ev GROUP BY code), w AS (SELECT code, count(DISTINCT event_id) AS placed, count(ret) AS days FROM win GROUP BY code) SELECT e.code, events, coalesce(placed, 0) AS placed, coalesce(days, 0) AS days FROM e LEFT JOIN w ON w.code = e.code")
def event_coverage(spark, sf_dir):
    return events.event_coverage(*_many(spark, sf_dir))


# ---- repairs -----------------------------------------------------------------------------------------------------


@query(f"WITH {RAW}, t AS (SELECT code, try_cast(datetime AS TIMESTAMP) AS t FROM raw), k AS (SELECT count(*) FILTER (n > 1) AS repeated FROM (SELECT count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY code, t)) SELECT count(*) AS rows, count(*) FILTER (t IS NULL) AS not_a_time, min(t) AS first, max(t) AS last, any_value(repeated) AS repeated FROM t, k")
def time_report(spark, sf_dir):
    return quality.time_report(raw(spark, sf_dir), "datetime", ["code"])


@query("WITH d AS (SELECT DISTINCT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date FROM lineitem), g AS (SELECT code, date_diff('day', lag(date) OVER (PARTITION BY code ORDER BY date), date) AS gap FROM d), c AS (SELECT code, gap, count(*) AS k FROM g WHERE gap IS NOT NULL GROUP BY code, gap) SELECT code, CAST(sum(k) AS BIGINT) AS n, CAST(arg_max(gap, struct_pack(a := k, b := -gap)) AS INTEGER) AS most_common_gap FROM c GROUP BY code")
def date_gaps(spark, sf_dir):
    return quality.gaps(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date")))


@query(f"WITH {RAW}, t AS (SELECT code, try_cast(datetime AS TIMESTAMP) AS datetime, value FROM raw) SELECT code, datetime, max(value) AS value FROM t WHERE datetime IS NOT NULL GROUP BY code, datetime")
def fixed_times(spark, sf_dir):
    return quality.fixed_times(raw(spark, sf_dir), "datetime", ["code"], "value").select("code", "datetime", "value")


@query("SELECT l_partkey, l_suppkey, count(*) AS rows, count(DISTINCT (l_quantity, l_discount)) AS versions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_quantity, l_discount)) > 1")
def inconsistent_keys(spark, sf_dir):
    return quality.inconsistent(load(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_quantity", "l_discount"])


@query("""WITH l AS (SELECT l_returnflag AS a, l_linestatus AS b, l_quantity AS q, l_discount AS d, count(DISTINCT l_tax) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity, l_discount) AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity, l_discount ORDER BY l_tax) AS n, l_tax AS t FROM lineitem)
SELECT a, b, q, d, t FROM l WHERE v > 1 OR n = 1""")
def strict_distinct(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    return quality.strict_distinct(lines, ["a", "b", "q", "d"], ["t"])


# ---- a whole run -------------------------------------------------------------------------------------------------


@query(f"""{PANEL}, {SNAPSHOTS}, {X_SQL.replace('FROM panel', 'FROM panel SEMI JOIN members USING (code, date)')}, {LABELS}, {WEIGHTS}, full_ AS (SELECT p.code, p.date, p.returns, coalesce(w.weight, 0) AS weight FROM panel p LEFT JOIN weights w ON p.code = w.code AND p.date = w.date),
d AS (SELECT date, coalesce(lag(weight) OVER (PARTITION BY code ORDER BY date), 0) * coalesce(returns, 0) AS r FROM full_), s AS (SELECT date, sum(r) AS ret FROM d GROUP BY date)
SELECT date, {R('ret', 'ret')}, {R('exp(sum(ln(1 + greatest(ret, -0.999999))) OVER (ORDER BY date))', 'nav')} FROM s""")
def factor_run(spark, sf_dir):
    """Universe, factor, groups, weights and the value they lead to, as one plan."""
    bars = panel(spark, sf_dir, once=True)
    inside = in_universe(bars.select("code", "date", (F.col("volume") / 100.0 + F.col("amount") / 1e6).alias("x")), _universe(bars))
    weights = cross_section.long_short_weights(cross_section.quantile_label(inside, "x", 5).where("label is not null"))
    full = bars.select("code", "date").join(weights.select("code", "date", "weight"), ["code", "date"], "left").select(F.lit("run").alias("portfolio"), "code", "date", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return neat(backtest.vector(full, bars.select("code", "date", F.col("returns").alias("ret"))).drop("portfolio"), "date")


# ---- scores, windows, choices ------------------------------------------------------------------------------------

TIMED = f"""{PANEL}, {X_SQL}, tf AS (SELECT code, date, x, CASE WHEN count(returns) OVER w = 3 THEN sum(returns) OVER w END AS f FROM x WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
tg AS (SELECT code, date, count(*) OVER w AS k, covar_pop(x, f) OVER w AS c, stddev_pop(x) OVER w * stddev_pop(f) OVER w AS s FROM tf WHERE x IS NOT NULL AND f IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
tic AS (SELECT code, date, CASE WHEN k = 12 AND s > 1e-12 THEN c / s END AS ic, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY date) <= count(*) OVER (PARTITION BY code) * 0.7 THEN 'in' ELSE 'out' END AS sample FROM tg),
rb AS (SELECT code, avg(ic) FILTER (sample = 'in') AS mean_in, stddev_samp(ic) FILTER (sample = 'in') AS si, avg(ic) FILTER (sample = 'out') AS mean_out, stddev_samp(ic) FILTER (sample = 'out') AS so FROM tic GROUP BY code),
rob AS (SELECT *, abs(mean_out - mean_in) / nullif(abs(mean_in), 0) AS decay FROM rb)"""


def _timed(spark, sf_dir) -> DataFrame:
    return signals.split(signals.timing_ic(xs(spark, sf_dir), "x", "returns", 3, 12), 0.7)


@query(f"{TIMED} SELECT code, {R('mean_in', 'mean_in')}, {R('mean_in / nullif(si, 0)', 'icir_in')}, {R('mean_out', 'mean_out')}, {R('mean_out / nullif(so, 0)', 'icir_out')}, {R('decay', 'decay')}, coalesce(sign(mean_in) = sign(mean_out) AND coalesce(decay, 0) < 0.5, FALSE) AS robust FROM rob")
def timing_robustness(spark, sf_dir):
    return neat(signals.robustness(_timed(spark, sf_dir)), "code", "robust").select("code", "mean_in", "icir_in", "mean_out", "icir_out", "decay", "robust")


@query(f"""{TIMED}, ics AS (SELECT code, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CAST(ic > 0 AS DOUBLE)) AS hr FROM tic GROUP BY code),
{SIG}, hits AS (SELECT code, (count(*) FILTER (signal > 0 AND x > 0) + count(*) FILTER (signal < 0 AND x < 0)) / nullif(CAST(count(*) FILTER (signal <> 0) AS DOUBLE), 0) AS hit FROM sg WHERE signal IS NOT NULL GROUP BY code),
ry AS (SELECT code, x, lead(returns) OVER (PARTITION BY code ORDER BY date) AS y FROM x), {REGRESSION.format(by='code', source='ry', least=10)},
pt AS (SELECT ics.code, CASE WHEN abs(coalesce(icir, 0)) >= 2 THEN 0.9 WHEN abs(coalesce(icir, 0)) >= 1 THEN 0.7 WHEN abs(coalesce(icir, 0)) >= 0.5 THEN 0.5 ELSE greatest(0.1, abs(coalesce(icir, 0)) / 2) END * 0.7 + least(coalesce(hr, 0.5), 1) * 0.3 AS a,
least(1, greatest(0, (coalesce(hit, 0.3) - 0.3) / 0.4)) AS b, least(1, coalesce(r2, 0) * 10) * 0.5 + CASE WHEN {t_p_sql('sqrt(f)', '(n - 2)')} < 0.05 THEN 0.5 ELSE 0 END AS c,
CASE WHEN mean_in IS NULL OR mean_out IS NULL THEN 0.1 ELSE CASE WHEN sign(mean_in) = sign(mean_out) THEN 0.5 ELSE 0 END + coalesce(greatest(0, 0.5 - least(decay, 1) * 0.5), 0) END AS d FROM ics LEFT JOIN hits USING (code) LEFT JOIN e USING (code) LEFT JOIN rob USING (code)),
sc AS (SELECT *, a * 0.30 + b * 0.25 + c * 0.20 + d * 0.25 AS score FROM pt)
SELECT code, {R('a', 'part_ic')}, {R('b', 'part_signal')}, {R('c', 'part_regression')}, {R('d', 'part_robust')}, {R('score', 'score')}, CASE WHEN round(score, 9) >= 0.8 THEN 'A' WHEN round(score, 9) >= 0.6 THEN 'B' WHEN round(score, 9) >= 0.4 THEN 'C' WHEN round(score, 9) >= 0.2 THEN 'D' ELSE 'F' END AS grade FROM sc""")
def timing_score(spark, sf_dir):
    timed = _timed(spark, sf_dir)
    ahead = xs(spark, sf_dir).withColumn("y", F.lead("returns").over(Window.partitionBy("code").orderBy("date")))
    tested = signals.signal_test(_signals(spark, sf_dir), "signal", "x", ["code"])
    found = signals.timing_score(evaluation.ic_summary(timed, ("code",)), tested, signals.regression(ahead, "y", "x", ["code"]), signals.robustness(timed))
    return neat(found, "code", "grade").select("code", "part_ic", "part_signal", "part_regression", "part_robust", "score", "grade")


@query(f"""{PANEL}, {X_SQL}, wy AS (SELECT code, date, x, lead(returns) OVER (PARTITION BY code ORDER BY date) AS y FROM x), wk AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS k FROM wy WHERE x IS NOT NULL AND y IS NOT NULL),
ww AS (SELECT code, x, y, CAST(unnest(generate_series(greatest(0, CAST(ceil((k - 23) / 12.0) AS BIGINT)), k // 12)) AS INTEGER) AS w FROM wk), {REGRESSION.format(by='code, w', source='ww', least=24)} SELECT code, w AS "window", n, {R('beta', 'beta')}, {R('sign(beta) * sqrt(f)', 't')}, {R('r2', 'r2')} FROM e""")
def window_regressions(spark, sf_dir):
    ahead = xs(spark, sf_dir).withColumn("y", F.lead("returns").over(Window.partitionBy("code").orderBy("date")))
    return neat(signals.window_regressions(ahead, "y", "x", 24, 12), "code", "window", "n")


@query(f"""{PANEL}, {YEARLY}, b AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY score DESC, gid) AS k FROM cand WHERE score IS NOT NULL), w AS (SELECT gid, count(*) AS wins, avg(score) AS m FROM b WHERE k = 1 GROUP BY gid) SELECT gid, wins, {R('m', 'mean_score')} FROM w WHERE wins >= (SELECT quantile_cont(wins, 0.5) FROM w)""")
def frequent_winners(spark, sf_dir):
    return neat(selection.frequent_winners(selection.wins(selection.champions(_candidates(spark, sf_dir), "score"), "score"), 0.5), "gid", "wins")


@query(f"""{PANEL}, {YEARLY} SELECT gid, CAST("window" AS INTEGER) AS "window", {R('score', 'score')}, CAST(rank() OVER (PARTITION BY "window" ORDER BY score DESC) AS INTEGER) AS rank FROM cand WHERE score IS NOT NULL""")
def candidate_ranks(spark, sf_dir):
    return neat(selection.ranks(_candidates(spark, sf_dir).select("gid", "window", "score"), "score"), "gid", "window", "rank")


@query(f"""{PANEL}, {YEARLY}, v AS (SELECT *, round(greatest(0, 10 - n) / 10.0 + greatest(0, -calm - 0.4) / 0.4, 12) AS v FROM cand WHERE score IS NOT NULL AND calm IS NOT NULL), fe AS (SELECT * FROM v WHERE v <= (SELECT min(v) FROM v) + 1e-12),
fr AS (SELECT * FROM fe WHERE NOT EXISTS (SELECT 1 FROM fe o WHERE o.score >= fe.score AND o.calm >= fe.calm AND (o.score > fe.score OR o.calm > fe.calm)))
SELECT gid, CAST("window" AS INTEGER) AS "window", {R('score', 'score')}, {R('calm', 'calm')}, {R('v', 'violation')}, score >= (SELECT quantile_cont(score, 0.8) FROM fr) AS top FROM fr""")
def selection_table(spark, sf_dir):
    limits = selection.violation({"n": ("min", 10.0), "spread": ("max", 0.4)})
    found = selection.selection_table(kept(_candidates(spark, sf_dir)).withColumn("spread", -F.col("calm")), "score", "calm", limits)
    return neat(found.select("gid", "window", "score", "calm", "violation", "top"), "gid", "window", "top").select("gid", "window", "score", "calm", "violation", "top")


@query(f"""{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, j AS (SELECT p.code, p.date, p.returns, CAST(sign(coalesce(weight, 0)) AS INTEGER) AS side FROM panel p LEFT JOIN weights w ON w.code = p.code AND w.date = p.date),
c AS (SELECT *, coalesce(CAST(side <> lag(side) OVER (PARTITION BY code ORDER BY date) AS INTEGER), 1) AS c FROM j), g AS (SELECT *, sum(c) OVER (PARTITION BY code ORDER BY date) AS segment FROM c),
sm AS (SELECT side, count(*) AS length, exp(sum(ln(1 + greatest(side * coalesce(returns, 0), -0.999999)))) - 1 AS ret FROM g WHERE side <> 0 GROUP BY code, segment, side)
SELECT side, count(*) AS segments, {R('avg(CAST(ret > 0 AS DOUBLE))', 'wins')}, {R('avg(ret)', 'mean')}, {R('avg(length)', 'mean_length')}, {R('max(ret)', 'best')}, {R('min(ret)', 'worst')} FROM sm GROUP BY side""")
def segment_metrics(spark, sf_dir):
    full = panel(spark, sf_dir).select("code", "date", "returns").join(weighted(spark, sf_dir).select("code", "date", "weight"), ["code", "date"], "left")
    return neat(portfolio.segment_metrics(portfolio.trade_segments(full, "returns")), "side", "segments")


@query(f"{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS} SELECT date, {R('sum(abs(weight))', 'stock')}, {R('1 - sum(weight)', 'cash')}, max_by(code, struct_pack(a := round(abs(weight), 12), b := -code)) AS \"primary\" FROM weights WHERE weight <> 0 GROUP BY date")
def stock_and_cash(spark, sf_dir):
    return neat(portfolio.stock_and_cash(weighted(spark, sf_dir).where("weight <> 0")), "date", "primary")


@query(f"WITH {MANY} SELECT code, day, count(ret) AS n, {R('avg(ret)', 'mean')}, {R('stddev_samp(ret)', 'std')} FROM win GROUP BY code, day")
def event_statistics_by_code(spark, sf_dir):
    rows = _many(spark, sf_dir)[1].withColumn("key", F.struct("code", "day"))
    return neat(events.day_statistics(rows, "key").select("key.code", "key.day", "n", "mean", "std"), "code", "day", "n")


@query(f"WITH {FIXED} SELECT code, day, count(*) AS n, {R('avg(cumulative)', 'cumulative')} FROM cu GROUP BY code, day")
def event_mean_curves(spark, sf_dir):
    return neat(events.mean_curves(_many(spark, sf_dir)[1]), "code", "day", "n")
