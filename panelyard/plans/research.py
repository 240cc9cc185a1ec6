"""Queries of the research operators over monthly bars, orders and user events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.operators import asof, backtest, cross_section, evaluation, events, quality, series, timing
from panelyard.plans.formulas import rounded, rounded_sql
from panelyard.sources import ingest
from panelyard.sources.panel import load, panel, panel_sql, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def neat(df: DataFrame, *keys: str) -> DataFrame:
    """Doubles rounded alike on both sides; keys as they are."""
    return df.select(*keys, *(rounded(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c not in keys))


def R(x: str, name: str) -> str:
    return f"{rounded_sql(x)} AS {name}"


PANEL = "WITH " + panel_sql("month")
FACTS = """facts AS (SELECT l_suppkey AS code, CAST(o_orderdate AS TIMESTAMP) AS datetime, max(o_totalprice) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
months AS (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS d FROM lineitem),
probes AS (SELECT s_suppkey AS code, CAST(d AS TIMESTAMP) AS input_ts FROM supplier, months)"""


def observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order values by supplier as facts, month ends by supplier as probes."""
    lines = load(spark, sf_dir, "lineitem")
    facts = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("code"), F.col("o_orderdate").cast("timestamp").alias("datetime")).agg(F.max("o_totalprice").alias("value"))
    months = lines.select(F.last_day("l_shipdate").alias("d")).distinct()
    ends = months.agg(F.collect_list("d").alias("ds"))  # a calendar: one date a month
    probes = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code")).join(F.broadcast(ends)).select("code", F.explode("ds").alias("d")).select("code", F.col("d").cast("timestamp").alias("input_ts"))
    return probes, facts


def _asof_sql(condition: str, near: str = "TRUE") -> str:
    gap = "abs(epoch_us(input_ts) - epoch_us(datetime)) / 3600000000.0"
    return f"""WITH {FACTS}, hit AS (SELECT p.code, p.input_ts, f.datetime, f.value FROM probes p ASOF LEFT JOIN facts f ON p.code = f.code AND {condition})
SELECT code, input_ts, CASE WHEN {near} THEN datetime END AS datetime, CASE WHEN {near} THEN value END AS value, CASE WHEN {near} THEN {gap} END AS diff_hours FROM hit"""


@query(_asof_sql("p.input_ts >= f.datetime"))
def asof_before(spark, sf_dir):
    return asof.nearest(*observations(spark, sf_dir), "before")


@query(_asof_sql("p.input_ts >= f.datetime", "epoch_us(input_ts) - epoch_us(datetime) <= 720 * 3600000000"))
def asof_before_tolerance(spark, sf_dir):
    return asof.nearest(*observations(spark, sf_dir), "before", 720)


@query(_asof_sql("p.input_ts < f.datetime"))
def asof_after(spark, sf_dir):
    return asof.nearest(*observations(spark, sf_dir), "after")


def _range_sql(pick: str, inside: str) -> str:
    return f"""WITH {FACTS}, spans AS (SELECT code, input_ts AS start_ts, input_ts + INTERVAL 10 DAY AS end_ts FROM probes)
SELECT s.code, start_ts, end_ts, {pick}(datetime) AS datetime, arg_{pick}(value, datetime) AS value
FROM spans s LEFT JOIN facts f ON s.code = f.code AND {inside} GROUP BY s.code, start_ts, end_ts"""


def _spans(spark, sf_dir):
    probes, facts = observations(spark, sf_dir)
    return probes.select("code", F.col("input_ts").alias("start_ts"), (F.col("input_ts") + F.expr("INTERVAL 10 DAYS")).alias("end_ts")), facts


@query(_range_sql("min", "datetime > start_ts AND datetime < end_ts"))
def asof_range_after(spark, sf_dir):
    return asof.nearest_in_range(*_spans(spark, sf_dir), "after")


@query(_range_sql("max", "datetime >= start_ts AND datetime <= end_ts"))
def asof_range_before(spark, sf_dir):
    return asof.nearest_in_range(*_spans(spark, sf_dir), "before")


PRIORITY = """history AS (SELECT l_suppkey AS code, CAST(o_orderdate AS TIMESTAMP) AS datetime, max(o_orderpriority) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
marked AS (SELECT *, lag(value) OVER (PARTITION BY code ORDER BY datetime) AS before, row_number() OVER (PARTITION BY code ORDER BY datetime) AS n FROM history),
spells AS (SELECT code, value, datetime AS valid_from, lead(datetime) OVER (PARTITION BY code ORDER BY datetime) AS valid_to FROM marked WHERE n = 1 OR before IS DISTINCT FROM value)"""


def _priorities(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    history = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("code"), F.col("o_orderdate").cast("timestamp").alias("datetime")).agg(F.max("o_orderpriority").alias("value"))
    return asof.intervals_of(history)


@query(f"WITH {PRIORITY} SELECT code, value, valid_from, valid_to FROM spells")
def validity_intervals(spark, sf_dir):
    return _priorities(spark, sf_dir)


@query(f"""WITH {FACTS}, {PRIORITY} SELECT p.code, p.input_ts, valid_from, s.value, valid_to FROM probes p
LEFT JOIN spells s ON p.code = s.code AND valid_from <= input_ts AND (valid_to IS NULL OR valid_to > input_ts)""")
def validity_join(spark, sf_dir):
    probes, _ = observations(spark, sf_dir)
    return asof.valid_at(probes, _priorities(spark, sf_dir))


SNAPSHOTS = """ranked AS (SELECT code, date, row_number() OVER (PARTITION BY date ORDER BY coalesce(amount, 0) DESC, code) AS ordinal, count(*) OVER (PARTITION BY date) AS size FROM panel WHERE month(date) IN (1, 7)),
snapshots AS (SELECT date AS effective_at, code, ordinal FROM ranked WHERE ordinal * 10 <= size * 3),
effective AS (SELECT DISTINCT effective_at FROM snapshots),
seen_at AS (SELECT date, max(effective_at) AS effective_at FROM (SELECT DISTINCT date FROM panel) d JOIN effective ON effective_at <= date GROUP BY date),
members AS (SELECT date, code, ordinal FROM seen_at JOIN snapshots USING (effective_at))"""


def _universe(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("date")
    ranked = bars.where(F.month("date").isin(1, 7)).withColumn("ordinal", F.row_number().over(w.orderBy(F.coalesce("amount", F.lit(0.0)).desc(), "code"))).withColumn("size", F.count("*").over(w))
    snapshots = ranked.where("ordinal * 10 <= size * 3").select(F.col("date").alias("effective_at"), "code", "ordinal")
    return asof.universe_at(bars.select("date").distinct(), snapshots)


@query(f"{PANEL}, {SNAPSHOTS} SELECT date, code, CAST(ordinal AS INTEGER) AS ordinal FROM members")
def universe_as_of(spark, sf_dir):
    return _universe(panel(spark, sf_dir))


@query(f"{PANEL}, {SNAPSHOTS} SELECT p.code, p.date, CASE WHEN m.code IS NOT NULL THEN close END AS close FROM panel p LEFT JOIN members m ON p.code = m.code AND p.date = m.date")
def universe_mask(spark, sf_dir):
    bars = panel(spark, sf_dir)
    return asof.mask_outside(bars, _universe(bars), ["close"]).select("code", "date", "close")


@query(f"{PANEL}, {SNAPSHOTS} SELECT p.code, p.date, close FROM panel p SEMI JOIN members m ON p.code = m.code AND p.date = m.date")
def universe_filter(spark, sf_dir):
    bars = panel(spark, sf_dir)
    return asof.in_universe(bars, _universe(bars)).select("code", "date", "close")


@query(f"""{PANEL}, listing AS (SELECT code, min(date) FILTER (volume IS NOT NULL) AS first_date, CASE WHEN code % 10 = 3 THEN max(date) FILTER (volume > 120) END AS last_date FROM panel GROUP BY code)
SELECT date, code, CASE WHEN first_date IS NULL OR date < first_date OR (last_date IS NOT NULL AND date > last_date) THEN -1 WHEN volume IS NULL OR (code + month(date)) % 23 = 0 THEN 0 ELSE 1 END AS status FROM panel JOIN listing USING (code)""")
def trade_status(spark, sf_dir):
    bars = panel(spark, sf_dir)
    listing = bars.groupBy("code").agg(F.min(F.when(F.col("volume").isNotNull(), F.col("date"))).alias("first_date"), F.when(F.col("code") % 10 == 3, F.max(F.when(F.col("volume") > 120, F.col("date")))).alias("last_date"))
    halted = bars.where(F.col("volume").isNull() | ((F.col("code") + F.month("date")) % 23 == 0)).select("code", "date", F.lit(0).alias("status"))
    return asof.trade_status(bars, listing, halted)


def _ends_sql() -> str:
    keys = {"W": "date_trunc('week', d)", "M": "date_trunc('month', d)", "Q": "date_trunc('quarter', d)", "S": "year(d) * 2 + CAST(month(d) > 6 AS INTEGER)", "Y": "year(d)"}
    return "WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) " + " UNION ALL ".join(f"SELECT '{p}' AS period, max(d) AS date FROM cal GROUP BY {k}" for p, k in keys.items())


@query(_ends_sql())
def calendar_period_ends(spark, sf_dir):
    calendar = load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    out = [asof.period_ends(calendar, p).select(F.lit(p).alias("period"), "date") for p in "WMQSY"]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query("WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT date, CAST(lead(date, 5) OVER (ORDER BY date) AS VARCHAR) AS shifted FROM cal")
def calendar_offset(spark, sf_dir):
    calendar = load(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return asof.shifted(calendar, calendar, 5).withColumn("shifted", F.col("shifted").cast("string"))


# ---- cross-sections ----------------------------------------------------------------------------------------------

X_SQL = "x AS (SELECT code, date, volume / 100.0 + amount / 1e6 AS x, cap, industry, returns, close, volume, amount FROM panel)"


def xs(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    return (panel(spark, sf_dir) if bars is None else bars).select("code", "date", (F.col("volume") / 100.0 + F.col("amount") / 1e6).alias("x"), "cap", "industry", "returns", "close", "volume", "amount")


CLIPS = {
    "mad": "m AS (SELECT date, quantile_cont(x, 0.5) AS m FROM x GROUP BY date), s AS (SELECT date, any_value(m) AS m, quantile_cont(abs(x - m), 0.5) AS s FROM x JOIN m USING (date) GROUP BY date), lim AS (SELECT date, m - 2 * s AS lo, m + 2 * s AS hi FROM s)",
    "std": "lim AS (SELECT date, avg(x) - 2 * stddev_samp(x) AS lo, avg(x) + 2 * stddev_samp(x) AS hi FROM x GROUP BY date)",
    "percentile": "lim AS (SELECT date, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM x GROUP BY date)",
}
for _m, _c in CLIPS.items():
    QUERIES[f"winsorize_{_m}"] = lambda spark, sf_dir, m=_m: neat(cross_section.winsorize(xs(spark, sf_dir), "x", m, 2.0).select("code", "date", "x"), "code", "date")
    ORACLE_SQL[f"winsorize_{_m}"] = f"{PANEL}, {X_SQL}, {_c} SELECT code, date, {R('CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END', 'x')} FROM x LEFT JOIN lim USING (date)"

SCALES = {
    "zscore": "coalesce((x - avg(x) OVER d) / nullif(stddev_samp(x) OVER d, 0), 0)",
    "minmax": "coalesce((x - min(x) OVER d) / nullif(max(x) OVER d - min(x) OVER d, 0), 0)",
    "rank": "(rank() OVER (PARTITION BY date, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) / count(x) OVER d",
}
for _m, _c in SCALES.items():
    QUERIES[f"standardize_{_m}"] = lambda spark, sf_dir, m=_m: neat(cross_section.standardize(xs(spark, sf_dir), "x", m).select("code", "date", "x"), "code", "date")
    ORACLE_SQL[f"standardize_{_m}"] = f"{PANEL}, {X_SQL}, y AS (SELECT code, date, CASE WHEN x IS NOT NULL THEN {_c} END AS x FROM x WINDOW d AS (PARTITION BY date)) SELECT code, date, {R('x', 'x')} FROM y"


@query(f"""{PANEL}, {X_SQL}, u AS (SELECT code, date, x, ln(cap) AS c, coalesce(CAST(industry AS VARCHAR), min(CAST(industry AS VARCHAR)) OVER (PARTITION BY date)) AS g FROM x WHERE x IS NOT NULL),
dm AS (SELECT code, date, x, g, x - avg(x) OVER (PARTITION BY date, g) AS y, c - avg(c) OVER (PARTITION BY date, g) AS z FROM u),
b AS (SELECT date, sum(y * z) / nullif(sum(z * z), 0) AS b, count(*) AS n, count(DISTINCT g) + 1 AS k FROM dm GROUP BY date),
r AS (SELECT code, date, CASE WHEN n < k + 5 THEN x ELSE y - coalesce(b, 0) * z END AS x FROM dm JOIN b USING (date))
SELECT x.code, x.date, {R('r.x', 'x')} FROM x LEFT JOIN r ON x.code = r.code AND x.date = r.date""")
def neutralize(spark, sf_dir):
    bars = xs(spark, sf_dir).withColumn("c", F.ln("cap"))
    return neat(cross_section.neutralize(bars, "x", "industry", "c").select("code", "date", "x"), "code", "date")


EDGES = "edges AS (SELECT date, list_distinct(quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM x GROUP BY date)"
LABELS = f"{EDGES}, labels AS (SELECT x.*, CASE WHEN x IS NOT NULL AND len(e) > 1 THEN greatest(0, len(list_filter(e, lambda q: q < x)) - 1) END AS label FROM x LEFT JOIN edges USING (date))"


def labelled(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    return cross_section.quantile_label(xs(spark, sf_dir, bars), "x", 5)


@query(f"{PANEL}, {X_SQL}, {LABELS} SELECT code, date, CAST(label AS INTEGER) AS label FROM labels")
def quantile_groups(spark, sf_dir):
    return labelled(spark, sf_dir).select("code", "date", "label")


@query(f"""{PANEL}, {X_SQL}, both_ AS (SELECT * FROM x WHERE x IS NOT NULL AND returns IS NOT NULL), e1 AS (SELECT date, list_distinct(quantile_cont(x, [0, 0.5, 1])) AS e FROM both_ GROUP BY date),
l1 AS (SELECT b.*, CASE WHEN len(e) > 1 THEN greatest(0, len(list_filter(e, lambda q: q < x)) - 1) END AS label_1 FROM both_ b JOIN e1 USING (date)),
e2 AS (SELECT date, label_1, list_distinct(quantile_cont(returns, [0, 0.25, 0.5, 0.75, 1])) AS e FROM l1 GROUP BY date, label_1)
SELECT code, l1.date, CAST(l1.label_1 AS INTEGER) AS label_1, CAST(CASE WHEN len(e) > 1 THEN greatest(0, len(list_filter(e, lambda q: q < returns)) - 1) END AS INTEGER) AS label_2 FROM l1 JOIN e2 ON l1.date = e2.date AND l1.label_1 IS NOT DISTINCT FROM e2.label_1""")
def dependent_double_sort(spark, sf_dir):
    return cross_section.double_sort(xs(spark, sf_dir), "x", "returns", 2, 4, True).select("code", "date", "label_1", "label_2")


WEIGHTS = """sided AS (SELECT *, max(label) OVER (PARTITION BY date) AS t, min(label) OVER (PARTITION BY date) AS b FROM labels WHERE label IS NOT NULL),
side AS (SELECT code, date, x, industry, returns, label, CASE WHEN t = b THEN 0 WHEN label = t THEN 1 WHEN label = b THEN -1 ELSE 0 END AS s FROM sided),
weights AS (SELECT code, date, x, industry, returns, label, s, CAST(s AS DOUBLE) / count(*) OVER (PARTITION BY date, s) AS weight FROM side)"""


def weighted(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    return cross_section.long_short_weights(labelled(spark, sf_dir, bars).where("label is not null"))


@query(f"{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS} SELECT code, date, {R('weight', 'weight')} FROM weights")
def long_short_weights(spark, sf_dir):
    return neat(weighted(spark, sf_dir).select("code", "date", "weight"), "code", "date")


@query(f"""{PANEL}, {X_SQL}, {LABELS}, sd AS (SELECT code, date, x, CASE WHEN label = 4 THEN 1 WHEN label IN (0, 1) THEN -1 ELSE 0 END AS s FROM labels WHERE label IS NOT NULL),
v AS (SELECT code, date, s, x * (CASE WHEN s < 0 THEN -1 ELSE 1 END) - min(x * (CASE WHEN s < 0 THEN -1 ELSE 1 END)) OVER (PARTITION BY date, s) AS v FROM sd)
SELECT code, date, {R('s * coalesce(v / nullif(sum(v) OVER (PARTITION BY date, s), 0), 1.0 / count(*) OVER (PARTITION BY date, s))', 'weight')} FROM v""")
def factor_value_weights(spark, sf_dir):
    return neat(cross_section.factor_weights(labelled(spark, sf_dir).where("label is not null"), "x", [4], [0, 1]).select("code", "date", "weight"), "code", "date")


@query(f"""{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, w AS (SELECT date, CAST(code AS VARCHAR) AS code, weight FROM weights WHERE s >= 0)
SELECT date, code, {R('weight', 'weight')} FROM w UNION ALL SELECT date, 'cash', {R('1 - sum(weight)', 'weight')} FROM w GROUP BY date""")
def weights_with_cash(spark, sf_dir):
    return neat(cross_section.with_cash(weighted(spark, sf_dir).where("weight >= 0").select("date", "code", "weight")), "date", "code")


@query(f"""{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, g AS (SELECT *, coalesce(CAST(industry AS VARCHAR), '__other__') AS g FROM weights WHERE s <> 0), k AS (SELECT date, s, count(DISTINCT g) AS k FROM g GROUP BY date, s)
SELECT code, date, {R('g.s / (CAST(k AS DOUBLE) * count(*) OVER (PARTITION BY date, g.s, g))', 'weight')} FROM g JOIN k USING (date, s)""")
def industry_equal_weights(spark, sf_dir):
    sided = weighted(spark, sf_dir).withColumn("s", F.signum("weight")).where("s != 0")
    return neat(cross_section.industry_weights(sided, "s", "industry").select("code", "date", "weight"), "code", "date")


@query(f"{PANEL}, {X_SQL}, {LABELS} SELECT CAST(date AS VARCHAR) AS date, CAST(label AS INTEGER) AS label, count(x) AS n, {R('avg(x)', 'mean')} FROM labels WHERE label IS NOT NULL GROUP BY CUBE (date, label)")
def group_table(spark, sf_dir):
    return neat(cross_section.group_table(labelled(spark, sf_dir), "label", "x").withColumn("date", F.col("date").cast("string")), "date", "label")


@query(f"""{PANEL}, {X_SQL}, {LABELS} SELECT date, CAST(label AS INTEGER) AS label, count(x) AS n, {R('avg(x)', 'mean')}, {R('stddev_samp(x)', 'std')}, {R('min(x)', 'low')}, {R('quantile_cont(x, 0.25)', 'q25')},
{R('quantile_cont(x, 0.5)', 'median')}, {R('quantile_cont(x, 0.75)', 'q75')}, {R('max(x)', 'high')} FROM labels WHERE label IS NOT NULL GROUP BY date, label""")
def group_statistics(spark, sf_dir):
    return neat(cross_section.group_statistics(labelled(spark, sf_dir), "label", "x"), "date", "label")


# ---- evaluation --------------------------------------------------------------------------------------------------

FORWARD = "f AS (SELECT *, lead(close) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 AS forward FROM labels)"
IC = """pair AS (SELECT code, date, x, forward FROM f WHERE x IS NOT NULL AND forward IS NOT NULL),
ranked AS (SELECT date, (rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY date ORDER BY forward) + (count(*) OVER (PARTITION BY date, forward) - 1) / 2.0) AS b FROM pair),
ic AS (SELECT date, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic FROM ranked GROUP BY date HAVING count(*) >= 5)"""
BASE = f"{PANEL}, {X_SQL}, {LABELS}, {FORWARD}"


def forward(spark, sf_dir) -> DataFrame:
    return evaluation.forward_return(labelled(spark, sf_dir), "close")


@query(f"{BASE}, {IC} SELECT date, n, {R('ic', 'ic')} FROM ic")
def rank_ic_series(spark, sf_dir):
    return neat(evaluation.information_coefficient(forward(spark, sf_dir), "x", "forward"), "date")


@query(f"{BASE}, {IC} SELECT count(ic) AS n, {R('avg(ic)', 'mean')}, {R('stddev_samp(ic)', 'std')}, {R('avg(ic) / stddev_samp(ic)', 'icir')}, {R('avg(CAST(ic > 0 AS DOUBLE))', 'hit_rate')}, {R('avg(ic) / stddev_samp(ic) * sqrt(count(ic))', 't')} FROM ic")
def ic_summary(spark, sf_dir):
    return neat(evaluation.ic_summary(evaluation.information_coefficient(forward(spark, sf_dir), "x", "forward")))


@query(f"{BASE}, {IC} SELECT date, n, {R('ic', 'ic')}, {R('CASE WHEN count(ic) OVER w = 12 THEN avg(ic) OVER w / nullif(stddev_samp(ic) OVER w, 0) END', 'icir')} FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_icir(spark, sf_dir):
    return neat(evaluation.rolling_icir(evaluation.information_coefficient(forward(spark, sf_dir), "x", "forward"), 12), "date")


REG = "reg AS (SELECT date, count(*) AS n, covar_samp(x, forward) AS c, var_samp(x) AS vx, var_samp(forward) AS vy, avg(x) AS mx, avg(forward) AS my FROM f WHERE x IS NOT NULL AND forward IS NOT NULL GROUP BY date HAVING count(*) >= 10)"


@query(f"{BASE}, {REG} SELECT date, n, {R('my - c / nullif(vx, 0) * mx', 'alpha')}, {R('c / nullif(vx, 0)', 'beta')}, {R('c * c / nullif(vx * vy, 0)', 'r2')} FROM reg")
def cross_regression(spark, sf_dir):
    return neat(evaluation.cross_regression(forward(spark, sf_dir), "forward", "x"), "date")


@query(f"{BASE}, {REG}, b AS (SELECT c / nullif(vx, 0) AS b FROM reg) SELECT count(b) AS n, {R('avg(b)', 'mean')}, {R('stddev_samp(b)', 'std')}, {R('avg(b) / stddev_samp(b) * sqrt(count(b))', 't')} FROM b")
def fama_macbeth(spark, sf_dir):
    return neat(evaluation.fama_macbeth(forward(spark, sf_dir), "forward", "x"))


@query(f"""{BASE}, g AS (SELECT date, label, avg(forward) AS ret FROM f WHERE label IS NOT NULL GROUP BY date, label),
s AS (SELECT date, arg_max(ret, label) - arg_min(ret, label) AS ret FROM g WHERE ret IS NOT NULL GROUP BY date)
SELECT date, CAST(label AS INTEGER) AS label, {R('ret', 'ret')} FROM g UNION ALL SELECT date, -1, {R('ret', 'ret')} FROM s""")
def group_returns(spark, sf_dir):
    return neat(evaluation.group_returns(forward(spark, sf_dir), "label", "forward"), "date", "label")


@query(f"""{PANEL}, {X_SQL}, p AS (SELECT code, x, dense_rank() OVER (ORDER BY date) AS p FROM x WHERE x IS NOT NULL), lags(k) AS (VALUES (1), (3), (6)),
pair AS (SELECT k, a.p, a.x AS u, b.x AS v FROM p a JOIN lags ON TRUE JOIN p b ON a.code = b.code AND b.p = a.p - k),
r AS (SELECT k, p, (rank() OVER (PARTITION BY k, p ORDER BY u) + (count(*) OVER (PARTITION BY k, p, u) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY k, p ORDER BY v) + (count(*) OVER (PARTITION BY k, p, v) - 1) / 2.0) AS b FROM pair),
c AS (SELECT k, p, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS c FROM r GROUP BY k, p HAVING count(*) >= 5)
SELECT k AS lag, count(c) AS n, {R('avg(c)', 'mean')} FROM c GROUP BY k""")
def factor_autocorrelation(spark, sf_dir):
    return neat(evaluation.autocorrelation(xs(spark, sf_dir), "x", [1, 3, 6]), "lag")


@query(f"""{PANEL}, {X_SQL}, e AS (SELECT date, quantile_cont(x, 0.8) AS e FROM x GROUP BY date), ch AS (SELECT code, date FROM x JOIN e USING (date) WHERE x >= e),
d AS (SELECT date, lag(date) OVER (ORDER BY date) AS b FROM (SELECT DISTINCT date FROM x WHERE x IS NOT NULL)), n AS (SELECT date, count(*) AS n FROM ch GROUP BY date),
k AS (SELECT ch.date, count(*) AS kept FROM ch JOIN d USING (date) JOIN ch o ON o.code = ch.code AND o.date = d.b GROUP BY ch.date)
SELECT n.date, n.n, coalesce(kept, 0) AS kept, {R('1 - coalesce(kept, 0) / CAST(o.n AS DOUBLE)', 'turnover')}, {R('coalesce(kept, 0) / CAST(n.n + o.n - coalesce(kept, 0) AS DOUBLE)', 'jaccard')}
FROM n JOIN d USING (date) JOIN n o ON o.date = d.b LEFT JOIN k ON k.date = n.date""")
def selection_turnover(spark, sf_dir):
    return neat(evaluation.selection_turnover(xs(spark, sf_dir), "x"), "date")


@query(f"""{PANEL}, {X_SQL}, m AS (SELECT date, avg(x) AS m FROM x GROUP BY date), a AS (SELECT date, count(x) AS n, count(*) - count(x) AS missing, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS low, max(x) AS high, quantile_cont(x, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q,
avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM x JOIN m USING (date) GROUP BY date)
SELECT date, n, missing, {R('mean', 'mean')}, {R('std', 'std')}, {R('low', 'low')}, {R('q[1]', 'q01')}, {R('q[2]', 'q25')}, {R('q[3]', 'median')}, {R('q[4]', 'q75')}, {R('q[5]', 'q99')}, {R('high', 'high')},
{R('CASE WHEN n > 2 THEN sqrt(n * (n - 1.0)) / (n - 2) * m3 / m2 ** 1.5 END', 'skew')}, {R('CASE WHEN n > 3 THEN (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) END', 'kurtosis')} FROM a""")
def factor_distribution(spark, sf_dir):
    return neat(evaluation.distribution(xs(spark, sf_dir), "x", ("date",)), "date")


@query(f"{PANEL}, {X_SQL} SELECT date, count(x) AS valid, {R('count(x) / CAST((SELECT count(DISTINCT code) FROM x WHERE x IS NOT NULL) AS DOUBLE)', 'ratio')} FROM x GROUP BY date")
def factor_coverage(spark, sf_dir):
    return neat(evaluation.coverage(xs(spark, sf_dir), "x"), "date")


# ---- series, timing, back-tests ----------------------------------------------------------------------------------


def navs(spark, sf_dir) -> DataFrame:
    return panel(spark, sf_dir).where(F.col("close").isNotNull()).select("code", "date", F.col("close").alias("nav"))


NAV = f"""{PANEL}, nav AS (SELECT code, date, close AS nav FROM panel WHERE close IS NOT NULL), r AS (SELECT *, nav / lag(nav) OVER w - 1 AS ret, nav / max(nav) OVER w - 1 AS dd FROM nav WINDOW w AS (PARTITION BY code ORDER BY date)),
run AS (SELECT *, sum(CAST(dd >= 0 AS INTEGER)) OVER (PARTITION BY code ORDER BY date) AS run FROM r), len AS (SELECT code, max(n) AS longest FROM (SELECT code, run, count(*) FILTER (dd < 0) AS n FROM run GROUP BY code, run) GROUP BY code),
q AS (SELECT code, quantile_cont(ret, 0.05) AS q FROM r GROUP BY code),
a AS (SELECT code, count(nav) AS n, arg_max(nav, date) / arg_min(nav, date) - 1 AS total, avg(ret) AS mean, stddev_samp(ret) AS std, min(dd) AS mdd, sqrt(avg(dd * dd)) AS ulcer, avg(abs(dd)) AS pain, stddev_samp(ret) FILTER (ret < 0) AS down,
any_value(q) AS q, avg(ret) FILTER (ret <= q) AS cvar, count(*) FILTER (ret > 0) / CAST(count(ret) AS DOUBLE) AS win, avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret < 0) AS payoff FROM r JOIN q USING (code) GROUP BY code),
s AS (SELECT a.*, longest, pow(1 + total, 252.0 / n) - 1 AS annual, sqrt(252.0) AS y FROM a JOIN len USING (code))"""


@query(NAV + f""" SELECT code, n, {R('total', 'total')}, {R('annual', 'annual')}, {R('std * y', 'volatility')}, {R('mean / nullif(std, 0) * y', 'sharpe')}, {R('mdd', 'max_drawdown')}, {R('annual / nullif(-mdd, 0)', 'calmar')}, {R('ulcer', 'ulcer')},
{R('annual / nullif(ulcer, 0)', 'martin')}, {R('pain', 'pain')}, {R('annual / nullif(pain, 0)', 'pain_ratio')}, CAST(longest AS BIGINT) AS longest_drawdown, {R('down', 'downside')}, {R('mean / nullif(down, 0) * y', 'sortino')}, {R('q', 'var_5')}, {R('cvar', 'cvar_5')}, {R('win', 'win_rate')}, {R('payoff', 'payoff')} FROM s""")
def performance_summary(spark, sf_dir):
    return neat(series.summary(navs(spark, sf_dir)), "code")


@query(NAV + f""", t AS (SELECT code, date, nav, ret, count(ret) OVER w AS k, avg(CAST(ret > 0 AS DOUBLE)) OVER w AS win, avg(ret) OVER w / nullif(stddev_samp(ret) OVER w, 0) * sqrt(252.0) AS sh FROM r WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT code, date, {R('nav', 'nav')}, {R('ret', 'ret')}, {R('CASE WHEN k = 12 THEN win END', 'win_rate')}, {R('CASE WHEN k = 12 THEN sh END', 'sharpe')} FROM t""")
def rolling_performance(spark, sf_dir):
    return neat(series.rolling(series.returns(navs(spark, sf_dir)), 12), "code", "date")


@query(f"""{PANEL}, m AS (SELECT date, avg(returns) AS b FROM panel GROUP BY date), a AS (SELECT code, covar_samp(returns, b) AS c, var_samp(b) AS v, avg(returns) AS m, avg(b) AS mb, stddev_samp(returns - b) AS te, avg(CAST(returns > b AS DOUBLE)) AS w FROM panel JOIN m USING (date) WHERE returns IS NOT NULL AND b IS NOT NULL GROUP BY code)
SELECT code, {R('c / nullif(v, 0)', 'beta')}, {R('(m - c / nullif(v, 0) * mb) * 252', 'alpha')}, {R('te * sqrt(252.0)', 'tracking_error')}, {R('(m - mb) / nullif(te, 0) * sqrt(252.0)', 'information_ratio')}, {R('w', 'win_share')} FROM a""")
def against_benchmark(spark, sf_dir):
    bars = panel(spark, sf_dir)
    market = bars.groupBy("date").agg(F.avg("returns").alias("bench"))
    return neat(series.against(bars.join(market, "date"), "returns", "bench"), "code")


@query(NAV + f""", e AS (SELECT code, date_trunc('month', date) AS m, arg_max(nav, date) AS v, arg_min(nav, date) AS f FROM nav GROUP BY 1, 2), mo AS (SELECT code, year(m) AS year, month(m) AS month, v / coalesce(lag(v) OVER (PARTITION BY code ORDER BY m), f) - 1 AS ret FROM e)
SELECT code, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, {R('ret', 'ret')} FROM mo UNION ALL SELECT code, CAST(year AS INTEGER), 0, {R('exp(sum(ln(1 + ret))) - 1', 'ret')} FROM mo GROUP BY code, year""")
def monthly_returns(spark, sf_dir):
    return neat(series.monthly_table(navs(spark, sf_dir)), "code", "year", "month")


@query(f"""{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, full_ AS (SELECT p.code, p.date, coalesce(w.weight, 0) AS weight FROM panel p LEFT JOIN weights w ON p.code = w.code AND p.date = w.date),
d AS (SELECT date, abs(weight - coalesce(lag(weight) OVER (PARTITION BY code ORDER BY date), 0)) AS d FROM full_) SELECT date, {R('sum(d) / 2', 'turnover')} FROM d GROUP BY date""")
def portfolio_turnover(spark, sf_dir):
    w = weighted(spark, sf_dir).select("code", "date", "weight")
    full = panel(spark, sf_dir).select("code", "date").join(w, ["code", "date"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return neat(series.turnover(full), "date")


@query(f"{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS} SELECT date, count(*) AS holdings, {R('sum(pow(abs(weight) / t, 2))', 'hhi')} FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY date) AS t FROM weights) WHERE weight <> 0 GROUP BY date")
def portfolio_concentration(spark, sf_dir):
    return neat(series.concentration(weighted(spark, sf_dir).select("code", "date", "weight")), "date")


@query(f"""{PANEL}, {X_SQL}, {LABELS}, {WEIGHTS}, full_ AS (SELECT p.code, p.date, p.returns, coalesce(w.weight, 0) AS weight FROM panel p LEFT JOIN weights w ON p.code = w.code AND p.date = w.date),
d AS (SELECT date, coalesce(lag(weight) OVER (PARTITION BY code ORDER BY date), 0) * coalesce(returns, 0) AS r FROM full_), s AS (SELECT date, sum(r) AS ret FROM d GROUP BY date)
SELECT 'top less bottom' AS portfolio, date, {R('ret', 'ret')}, {R('exp(sum(ln(1 + greatest(ret, -0.999999))) OVER (ORDER BY date))', 'nav')} FROM s""")
def vector_backtest(spark, sf_dir):
    bars = panel(spark, sf_dir, once=True)
    w = bars.select("code", "date").join(weighted(spark, sf_dir, bars).select("code", "date", "weight"), ["code", "date"], "left").select(F.lit("top less bottom").alias("portfolio"), "code", "date", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return neat(backtest.vector(w, bars.select("code", "date", F.col("returns").alias("ret"))), "portfolio", "date")


@query(f"""{PANEL}, {X_SQL}, v AS (SELECT * FROM x WHERE x IS NOT NULL), t AS (SELECT code, date, x, count(x) OVER w AS k, avg(x) OVER w + 0.5 * stddev_samp(x) OVER w AS th FROM v WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT code, date, {R('CASE WHEN k = 12 THEN th END', 'threshold')}, CASE WHEN k = 12 THEN CAST(x > th AS DOUBLE) END AS weight FROM t""")
def rolling_threshold(spark, sf_dir):
    return neat(timing.rolling_threshold(xs(spark, sf_dir), "x", 12, 0.5).select("code", "date", "threshold", "weight"), "code", "date", "weight").select("code", "date", "threshold", "weight")


@query(f"""{PANEL}, act AS (SELECT code, date, returns, coalesce(returns > 0, FALSE) AS a FROM panel), st AS (SELECT *, CAST(a AND NOT coalesce(lag(a) OVER (PARTITION BY code ORDER BY date), FALSE) AS INTEGER) AS s FROM act),
ru AS (SELECT *, sum(s) OVER (PARTITION BY code ORDER BY date) AS run FROM st), d AS (SELECT code, date, run, returns, returns - lag(returns) OVER (PARTITION BY code, run ORDER BY date) AS d FROM ru WHERE a)
SELECT code, CAST(run AS BIGINT) AS run, min(date) AS start, max(date) AS end, count(*) AS length, {R('sum(returns)', 'total')}, {R('arg_min(returns, date)', 'first')}, {R('arg_max(returns, date)', 'last')}, {R('max(returns)', 'high')}, {R('min(returns)', 'low')}, {R('avg(returns)', 'mean')},
{R('quantile_cont(returns, 0.5)', 'median')}, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, {R('arg_max(returns, date) - arg_min(returns, date)', 'change')} FROM d GROUP BY code, run""")
def active_runs(spark, sf_dir):
    return neat(timing.run_table(timing.runs(panel(spark, sf_dir), F.col("returns") > 0), "returns"), "code", "run")


def _rules_sql() -> str:
    three = lambda up, down: f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"
    rules = {"band": three("x > m + s", "x < m - s"), "average": three("x > ma", "x < ma"), "extreme": three("x >= q[2]", "x <= q[1]"), "sign": three("x > 0", "x < 0"), "change": three("x > b", "x < b"), "average_change": three("ma > mb", "ma < mb")}
    base = f"""{PANEL}, v AS (SELECT code, date, returns AS x FROM panel WHERE returns IS NOT NULL), g AS (SELECT code, avg(x) AS m, stddev_samp(x) AS s, quantile_cont(x, [0.2, 0.8]) AS q FROM v GROUP BY code),
t AS (SELECT code, date, x, avg(x) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma, lag(x) OVER (PARTITION BY code ORDER BY date) AS b FROM v), u AS (SELECT t.*, g.m, g.s, g.q, lag(ma) OVER (PARTITION BY t.code ORDER BY date) AS mb FROM t JOIN g ON t.code = g.code) """
    return base + " UNION ALL ".join(f"SELECT code, date, '{k}' AS rule, {c} AS signal FROM u" for k, c in rules.items())


@query(_rules_sql())
def rule_signals(spark, sf_dir):
    return timing.rule_signals(panel(spark, sf_dir), "returns")


# ---- event study -------------------------------------------------------------------------------------------------

EVENTS = """px AS (SELECT event_type AS code, CAST(ts AS DATE) AS date, sum(value) + 1 AS price FROM events GROUP BY 1, 2),
bar AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS bar, price / nullif(lag(price) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM px),
ev AS (SELECT 'view' AS code, CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS DATE) + CAST(hour(ts) >= 15 AS INTEGER) AS due FROM events WHERE event_type = 'purchase'),
zero AS (SELECT ev.code, event_id, min(bar) AS zero FROM ev JOIN bar ON bar.code = ev.code AND bar.date >= due GROUP BY ev.code, event_id),
win AS (SELECT z.code, event_id, CAST(b.bar - zero AS INTEGER) AS day, ret FROM zero z JOIN bar b ON b.code = z.code AND b.bar BETWEEN zero - 3 AND zero + 5)"""


def _event_rows(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    prices = e.groupBy(F.col("event_type").alias("code"), F.to_date("ts").alias("date")).agg((F.sum("value") + 1).alias("price"))
    bought = e.where("event_type = 'purchase'").select(F.lit("view").alias("code"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("event_ts"))
    return events.window_returns(bought, prices, 3, 5)


@query(f"WITH {EVENTS} SELECT day, count(ret) AS n, {R('avg(ret)', 'mean')}, {R('stddev_samp(ret)', 'std')}, {R('count(*) FILTER (ret > 0) / nullif(CAST(count(ret) AS DOUBLE), 0)', 'p_up')}, {R('count(*) FILTER (ret > 0) / nullif(CAST(count(*) FILTER (ret < 0) AS DOUBLE), 0)', 'odds')}, {R('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(count(ret))', 't')} FROM win GROUP BY day")
def event_day_statistics(spark, sf_dir):
    return neat(events.day_statistics(_event_rows(spark, sf_dir)), "day")


@query(f"""WITH {EVENTS}, g AS (SELECT *, ln(1 + coalesce(ret, 0)) AS g FROM win) SELECT code, event_id, day, {R('ret', 'ret')},
{R('exp(CASE WHEN day >= 0 THEN sum(CASE WHEN day >= 0 THEN g END) OVER (PARTITION BY code, event_id ORDER BY day) ELSE sum(CASE WHEN day <= 0 THEN g END) OVER (PARTITION BY code, event_id ORDER BY day DESC) END) - 1', 'cumulative')} FROM g""")
def event_cumulative_returns(spark, sf_dir):
    return neat(events.cumulative(_event_rows(spark, sf_dir)), "code", "event_id", "day")


# ---- quality and ingest ------------------------------------------------------------------------------------------


@query(f"""{PANEL} SELECT 'close' AS column, count(*) FILTER (close IS NULL) AS missing, {R('count(*) FILTER (close IS NULL) / CAST(count(*) AS DOUBLE)', 'share')} FROM panel
UNION ALL SELECT 'industry', count(*) FILTER (industry IS NULL), {R('count(*) FILTER (industry IS NULL) / CAST(count(*) AS DOUBLE)', 'share')} FROM panel""")
def null_report(spark, sf_dir):
    return neat(quality.null_report(panel(spark, sf_dir), ["close", "industry"]), "column")


@query("SELECT l_orderkey, l_suppkey, count(*) AS rows, count(DISTINCT l_quantity) AS values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) > 1")
def key_conflicts(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return quality.conflicts(spread(lines, lines.count(), "l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"], "l_quantity")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def keep_last(spark, sf_dir):
    return quality.keep_one(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


FILLS = {
    "ffill": "coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date))",
    "bfill": "coalesce(close, first_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    "mean": "coalesce(close, avg(close) OVER (PARTITION BY code))", "median": "coalesce(close, quantile_cont(close, 0.5) OVER (PARTITION BY code))", "value": "coalesce(close, 0.0)",
}
for _m, _c in FILLS.items():
    QUERIES[f"fill_{_m}"] = lambda spark, sf_dir, m=_m: neat(quality.fill(panel(spark, sf_dir).select("code", "date", "close"), "close", m), "code", "date")
    ORACLE_SQL[f"fill_{_m}"] = f"{PANEL}, y AS (SELECT code, date, {_c} AS close FROM panel) SELECT code, date, {R('close', 'close')} FROM y"


@query(f"""{PANEL} SELECT code, date, 'close' AS metric, {R('close', 'value')} FROM panel WHERE close IS NOT NULL UNION ALL SELECT code, date, 'volume', {R('volume', 'value')} FROM panel WHERE volume IS NOT NULL""")
def wide_to_long(spark, sf_dir):
    return neat(ingest.melted(panel(spark, sf_dir).select("code", "date", "close", F.col("volume").cast("double").alias("volume")), ["code", "date"]), "code", "date", "metric")


@query("""WITH old AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS value FROM supplier WHERE s_suppkey % 5 <> 0), new AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal + 1 END AS value FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(old.code, new.code) AS code, coalesce(new.value, old.value) AS value FROM old FULL JOIN new ON old.code = new.code""")
def upsert(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), "s_acctbal")
    old = s.where("code % 5 != 0").select("code", F.when(F.col("code") % 3 != 0, F.col("s_acctbal")).alias("value"))
    new = s.where("code % 2 = 0").select("code", F.when(F.col("code") % 4 != 0, F.col("s_acctbal") + 1).alias("value"))
    return ingest.upserted(old, new, ["code"])
