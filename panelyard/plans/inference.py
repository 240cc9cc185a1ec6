"""Queries of tests with p values, regressions on several factors and bootstrap tests, with their SQL.

SQL finds tail probabilities its own way: t and F tails are ratios of integrals of powers of cosines, by Simpson's rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import bootstrap, evaluation, regression, signals
from panelyard.plans.research import BASE, IC, PANEL, X_SQL, R, forward, neat, xs
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


def _simpson(low: str, high: str, power: str, steps: int = 1000) -> str:
    at = f"({low} + k * ({high} - {low}) / {steps})"
    return f"(({high} - {low}) * list_sum(list_transform(range(0, {steps + 1}), lambda k: (CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {power.format(at=at)})))"


def t_p_sql(t: str, n: str) -> str:
    """Two-sided p of t with n degrees of freedom: the share of cos^(n - 1) beyond atan(|t| / sqrt(n)), integrated from the
    far end over its fourth root, where the integrand is smooth for any n of at least 1."""
    power = f"(pow({{at}}, 3) * pow(abs(sin(pow({{at}}, 4))), {n} - 1))"
    return f"(CASE WHEN {n} > 0 THEN {_simpson('0', f'pow(pi() / 2 - atan(abs({t}) / sqrt({n})), 0.25)', power, 4000)} / {_simpson('0', 'pow(pi() / 2, 0.25)', power, 4000)} END)"


def f_p_sql(f: str, m: str, n: str) -> str:
    power = f"(pow(abs(sin({{at}})), {n} - 1) * pow(abs(cos({{at}})), {m} - 1))"
    return f"({_simpson('0', f'asin(sqrt({n} / ({n} + {m} * {f})))', power)} / {_simpson('0', '(pi() / 2)', power)})"


def two_sql(name: str, source: str, by: str, y: str, a: str, b: str, least: int = 4) -> str:
    """CTEs that end in `name`: by, n, alpha, b1, b2, their t values, r2 of y on two regressors, by Cramer's rule."""
    return f"""{name}_m AS (SELECT {by}, count(*) AS n, avg({y}) AS my, avg({a}) AS m1, avg({b}) AS m2, var_pop({a}) AS s11, var_pop({b}) AS s22, covar_pop({a}, {b}) AS s12, covar_pop({a}, {y}) AS s1, covar_pop({b}, {y}) AS s2, var_pop({y}) AS sy
  FROM {source} WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {by}),
{name}_b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM {name}_m WHERE n >= {least} AND s11 > 0 AND s22 > 0 AND (s11 * s22 - s12 * s12) > 1.0000000001e-10 * s11 * s22),
{name}_e AS (SELECT *, my - b1 * m1 - b2 * m2 AS alpha, greatest(0, sy - b1 * s1 - b2 * s2) / (n - 3) AS v, 1 - greatest(0, sy - b1 * s1 - b2 * s2) / sy AS r2 FROM {name}_b),
{name} AS (SELECT *, alpha / nullif(sqrt(n * v * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * det))), 0) AS t0, b1 / nullif(sqrt(v * s22 / det), 0) AS t1, b2 / nullif(sqrt(v * s11 / det), 0) AS t2 FROM {name}_e)"""


def _lagged(spark, sf_dir) -> DataFrame:
    """A supplier's monthly return beside the market's and its own before, one bar back."""
    w = Window.partitionBy("code").orderBy("date")
    bars = panel(spark, sf_dir, once=True).select("code", "date", "returns")
    market = bars.groupBy("date").agg(F.avg("returns").alias("market"))
    return bars.join(market, "date").select("code", "date", F.col("returns").alias("y"), F.lag("returns").over(w).alias("own"), F.lag("market").over(w).alias("market"))


_LAGGED = f"""{PANEL}, mk AS (SELECT date, avg(returns) AS market FROM panel GROUP BY date),
lagged AS (SELECT code, date, returns AS y, lag(returns) OVER w AS own, lag(market) OVER w AS market FROM panel JOIN mk USING (date) WINDOW w AS (PARTITION BY code ORDER BY date))"""


@query(f"""{_LAGGED}, {two_sql('fit', 'lagged', 'code', 'y', 'own', 'market')}, long AS (SELECT code, n, unnest(['const', 'own', 'market']) AS term, unnest([alpha, b1, b2]) AS beta, unnest([t0, t1, t2]) AS t FROM fit)
SELECT code, term, {R('beta', 'beta')}, {R('t', 't')}, {R(t_p_sql('t', '(n - 3)'), 'p_value')} FROM long""")
def factor_regressions(spark, sf_dir):
    """Every supplier's returns on two factors: coefficients, t and p values."""
    fit = regression.ols(_lagged(spark, sf_dir), "y", ["own", "market"], ["code"])
    return neat(regression.terms(fit, ["own", "market"], ["code"]).drop("se"), "code", "term")


@query(f"""{_LAGGED}, {two_sql('fit', 'lagged', 'code', 'y', 'own', 'market')}, g AS (SELECT code, n, r2, r2 * (n - 3) / (2 * (1 - r2)) AS f FROM fit)
SELECT code, n, {R('r2', 'r2')}, {R('1 - (1 - r2) * (n - 1) / (n - 3)', 'adj_r2')}, {R('f', 'f')}, {R(f_p_sql('f', '2', '(n - 3)'), 'f_p_value')} FROM g""")
def regression_quality(spark, sf_dir):
    fit = regression.ols(_lagged(spark, sf_dir), "y", ["own", "market"], ["code"])
    return neat(regression.fit_p_value(fit, 2).select("code", "n", "r2", "adj_r2", "f", "f_p_value"), "code", "n")


@query(f"""{BASE}, fm AS (SELECT date, forward AS y, x, returns AS z, coalesce(CAST(industry AS VARCHAR), '') AS g FROM f WHERE x IS NOT NULL AND forward IS NOT NULL AND returns IS NOT NULL),
fn AS (SELECT * FROM fm QUALIFY count(*) OVER (PARTITION BY date) >= 7),
fw AS (SELECT date, y - avg(y) OVER c AS y, x - avg(x) OVER c AS x, z - avg(z) OVER c AS z FROM fn WINDOW c AS (PARTITION BY date, g)), {two_sql('fit', 'fw', 'date', 'y', 'x', 'z')},
sl AS (SELECT unnest(['x', 'returns']) AS factor, unnest([b1, b2]) AS slope FROM fit), st AS (SELECT factor, count(slope) AS n, avg(slope) AS mean, stddev_samp(slope) AS std FROM sl GROUP BY factor)
SELECT factor, n, {R('mean', 'mean')}, {R('std', 'std')}, {R('mean / nullif(std, 0) * sqrt(n)', 't')}, {R(t_p_sql('(mean / nullif(std, 0) * sqrt(n))', '(n - 1)'), 'p_value')} FROM st""")
def fama_macbeth_industries(spark, sf_dir):
    """Slopes of two factors with industry dummies, by date, and whether their means differ from 0."""
    return neat(regression.fama_macbeth(kept(forward(spark, sf_dir).select("date", "forward", "x", "returns", "industry")), "forward", ["x", "returns"], "industry"), "factor", "n")


@query(f"""{BASE}, {IC}, s AS (SELECT count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic)
SELECT n, {R('mean', 'mean')}, {R('std', 'std')}, {R('mean / nullif(std, 0) * sqrt(n)', 't')}, {R(t_p_sql('(mean / nullif(std, 0) * sqrt(n))', '(n - 1)'), 'p_value')} FROM s""")
def ic_significance(spark, sf_dir):
    return neat(regression.t_test(evaluation.information_coefficient(forward(spark, sf_dir), "x", "forward"), "ic"), "n")


_HORIZONS = (1, 3, 5, 10, 20)


@query(f"""{PANEL}, {X_SQL}, h AS (SELECT code, date, x, close, unnest([{', '.join(map(str, _HORIZONS))}]) AS horizon, unnest([{', '.join(f'lead(close, {k}) OVER w / nullif(close, 0) - 1' for k in _HORIZONS)}]) AS forward FROM x WINDOW w AS (PARTITION BY code ORDER BY date)),
g AS (SELECT horizon, code, count(*) AS n, covar_pop(x, forward) AS c, var_pop(x) AS vx, var_pop(forward) AS vy FROM h WHERE x IS NOT NULL AND forward IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
e AS (SELECT horizon, code, n, c / nullif(vx, 0) AS beta, c * c / nullif(vx * vy, 0) AS r2 FROM g), f AS (SELECT *, sign(beta) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) AS t FROM e)
SELECT code, CAST(horizon AS INTEGER) AS horizon, n, {R('sign(beta) * sqrt(r2)', 'ic')}, {R('beta', 'beta')}, {R('t', 't')}, {R('r2', 'r2')}, {R(t_p_sql('t', '(n - 2)'), 'p_value')} FROM f""")
def prediction_by_horizon(spark, sf_dir):
    """For every supplier and horizon: correlation and regression of the later return on the factor, with p values."""
    ahead = signals.horizons(kept(xs(spark, sf_dir).select("code", "date", "x", "close")), "close", list(_HORIZONS))
    fitted = regression.one_regressor(signals.regression(ahead, "forward", "x", ["horizon", "code"]))
    return neat(fitted.select("code", "horizon", "n", (F.signum("beta") * F.sqrt("r2")).alias("ic"), "beta", "t", "r2", "p_value"), "code", "horizon", "n")


# ---- bootstrap ---------------------------------------------------------------------------------------------------


def _market(spark, sf_dir) -> DataFrame:
    """Daily means over all trade lines."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return kept(load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.avg(unit * (1 - F.col("l_discount"))).alias("y"), F.avg("l_discount").alias("discount"), F.avg(unit).alias("price"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity")))


FACTORS = ("discount", "price", "tax", "quantity")
DRAW = "CAST('0x' || substr(md5({seed} || ':' || {replicate} || ':' || {slot}), 1, 8) AS BIGINT) % {rows}"
_T = "(CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-15 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END)"


def _t_sql(y: str, x: str) -> str:
    r = _T.format(x=x, y=y)
    return f"({r} * sqrt(count(*) - 2) / nullif(sqrt(1 - {r} * {r}), 0))"


@query(f"""WITH mk AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity * (1 - l_discount)) AS y, avg(l_discount) AS discount, avg(l_extendedprice / l_quantity) AS price, avg(l_tax) AS tax, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1),
nm AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM mk),
long AS (SELECT place, y, unnest(['discount', 'price', 'tax', 'quantity']) AS factor, unnest([discount, price, tax, quantity]) AS x FROM nm),
pk AS MATERIALIZED (SELECT r, {DRAW.format(seed="'1'", replicate='r', slot='place', rows='n')} AS place FROM nm, (SELECT unnest(range(0, 100)) AS r)),
bt AS (SELECT r, factor, {_t_sql('y', 'x')} AS t FROM pk JOIN long USING (place) GROUP BY r, factor), mx AS (SELECT r, abs(max(t)) AS m FROM bt GROUP BY r),
own AS (SELECT factor, {_t_sql('y', 'x')} AS t FROM long GROUP BY factor)
SELECT factor, {R('t', 't')}, {R('(SELECT avg(CAST(m >= abs(t) AS DOUBLE)) FROM mx)', 'p_value')} FROM own""")
def bootstrap_max_t(spark, sf_dir):
    """Daily factors of the market's mean price; draws are digests that both engines make."""
    return neat(bootstrap.max_t_test(bootstrap.long_form(_market(spark, sf_dir), "y", FACTORS), 100, 1), "factor")


@query()
def bootstrap_incremental(spark, sf_dir):
    """Which daily factors add to those already accepted; the driver steers, so tests hold it against a loop."""
    return neat(bootstrap.incremental_test(_market(spark, sf_dir), "y", FACTORS, 100, 1), "round", "factor", "significant")


def _alpha_sql(source: str, by: str, replicates: int, least: int) -> str:
    keys = [c.strip() for c in by.split(",")]
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    named = ", ".join(f"r.{c}" for c in keys)
    return f"""wh AS (SELECT * FROM {source} WHERE y IS NOT NULL AND own IS NOT NULL AND market IS NOT NULL), {two_sql('fit', 'wh', by, 'y', 'own', 'market', least)},
rw AS MATERIALIZED (SELECT {', '.join(f'w.{c}' for c in keys)}, row_number() OVER (PARTITION BY {', '.join(f'w.{c}' for c in keys)} ORDER BY date) - 1 AS place, n, y - alpha AS fake, own, market FROM wh w JOIN fit ON {same('w', 'fit')}),
pk AS MATERIALIZED (SELECT {by}, r, {DRAW.format(seed="'1'", replicate='r', slot='place', rows='n')} AS place FROM rw, (SELECT unnest(range(0, {replicates})) AS r)),
sm AS (SELECT {named}, p.r, fake, own, market FROM pk p JOIN rw r ON {same('p', 'r')} AND p.place = r.place), {two_sql('fk', 'sm', by + ', r', 'fake', 'own', 'market')},
jd AS (SELECT {', '.join(f'fit.{c}' for c in keys)}, avg(CAST(abs(fk.t0) >= abs(fit.t0) AS DOUBLE)) AS p FROM fk JOIN fit ON {same('fk', 'fit')} GROUP BY {', '.join(f'fit.{c}' for c in keys)})
SELECT {', '.join(f'fit.{c}' for c in keys)}, n, {R('alpha', 'alpha')}, {R('t0', 'alpha_t')}, {R('p', 'alpha_p')} FROM fit LEFT JOIN jd ON {same('fit', 'jd')}"""


@query(f"{_LAGGED}, {_alpha_sql('lagged', 'code', 40, 30)}")
def fund_alphas(spark, sf_dir):
    """Every supplier as a fund, against factors one bar back."""
    return neat(bootstrap.alpha_test(kept(_lagged(spark, sf_dir)), "y", ["own", "market"], ["code"], 40, 1, 30), "code", "n")


SEGMENTS = (("early", "1995-01-01", "1997-12-31"), ("late", "1999-01-01", "2001-12-31"), ("whole", "1995-01-01", "2001-12-31"))


@query(f"{_LAGGED}, sg AS (SELECT l.*, segment FROM lagged l JOIN (VALUES {', '.join(str(s) for s in SEGMENTS)}) s(segment, a, b) ON date BETWEEN CAST(a AS DATE) AND CAST(b AS DATE)), {_alpha_sql('sg', 'code, segment', 20, 30)}")
def segment_alphas(spark, sf_dir):
    return neat(bootstrap.alpha_test(bootstrap.segments(kept(_lagged(spark, sf_dir)), SEGMENTS), "y", ["own", "market"], ["code", "segment"], 20, 1, 30), "code", "segment", "n")
