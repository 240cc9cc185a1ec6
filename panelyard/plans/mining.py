"""Queries of parameter sweeps: a grid of momentum factors over monthly mean prices, scored over windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import asof, selection, sweep
from panelyard.plans.research import PANEL, SNAPSHOTS, R, _universe, neat
from panelyard.sources.panel import kept, panel

QUERIES: dict = {}
ORACLE_SQL: dict = {}

GRID = {"lookback": [1, 3, 6, 12], "skip": [0, 1], "groups": [3, 5, 10]}
YEAR = 12.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _evaluated(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates, their series, their coefficients and the calendar; bars are read once, clean values are computed once."""
    bars = panel(spark, sf_dir, once=True, only=("amount", "vwap"))
    rows = selection.grid(spark, GRID).collect()  # a grid has at most `cap` rows
    kinds = {pair: k for k, pair in enumerate(dict.fromkeys((r.lookback, r.skip) for r in rows))}
    candidates = [(r.gid, kinds[r.lookback, r.skip], r.groups) for r in rows]
    w = Window.partitionBy("code").orderBy("date")
    variants = {k: F.try_divide(F.lag("vwap", skip).over(w), F.lag("vwap", skip + back).over(w)) - 1 for (back, skip), k in kinds.items()}
    inside = asof.mask_outside(bars.withColumn("inside", F.lit(True)), _universe(bars), ["inside"])
    clean = kept(sweep.cleaned(sweep.exposures(inside, variants, "vwap", F.col("inside"))))
    calendar = sweep.next_dates(bars)
    daily = kept(sweep.series(sweep.portfolios(clean, [n for _, _, n in candidates]), candidates, calendar))
    return spark.createDataFrame([(g, f) for g, f, _ in candidates], "gid int, fid int"), daily, kept(sweep.coefficients(clean)), calendar


_FACTORS = "(VALUES " + ", ".join(f"({k}, {b}, {s})" for k, (b, s) in enumerate((b, s) for b in GRID["lookback"] for s in GRID["skip"])) + ") f(fid, back, skip)"
_CANDIDATES = "(VALUES " + ", ".join(f"({i}, {i // 3}, {n})" for i, n in enumerate(n for b in GRID["lookback"] for s in GRID["skip"] for n in GRID["groups"])) + ") c(gid, fid, n)"
_SWEEP = f"""{PANEL}, {SNAPSHOTS}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, lead(date) OVER (ORDER BY date) AS next, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
pi AS MATERIALIZED (SELECT p.code, p.date, i, vwap, lead(vwap) OVER (PARTITION BY p.code ORDER BY p.date) / nullif(vwap, 0) - 1 AS forward FROM panel p JOIN cal USING (date)),
fx AS (SELECT a.code, a.date, fid, b.vwap / nullif(c.vwap, 0) - 1 AS x, a.forward FROM pi a JOIN members m ON m.code = a.code AND m.date = a.date, {_FACTORS}, pi b, pi c
  WHERE b.code = a.code AND b.i = a.i - skip AND c.code = a.code AND c.i = a.i - skip - back),
f0 AS (SELECT * FROM fx WHERE x IS NOT NULL), md AS (SELECT fid, date, quantile_cont(x, 0.5) AS m FROM f0 GROUP BY 1, 2),
sd AS (SELECT fid, date, any_value(m) AS m, quantile_cont(abs(x - m), 0.5) AS s FROM f0 JOIN md USING (fid, date) GROUP BY 1, 2),
cl AS (SELECT code, date, fid, forward, greatest(least(x, m + 3 * s), m - 3 * s) AS x FROM f0 JOIN sd USING (fid, date)),
z AS MATERIALIZED (SELECT code, date, fid, forward, round(coalesce((x - avg(x) OVER d) / nullif(stddev_samp(x) OVER d, 0), 0), 10) AS x FROM cl WINDOW d AS (PARTITION BY fid, date)),
icr AS (SELECT fid, date, (rank() OVER (PARTITION BY fid, date ORDER BY x) + (count(*) OVER (PARTITION BY fid, date, x) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY fid, date ORDER BY forward) + (count(*) OVER (PARTITION BY fid, date, forward) - 1) / 2.0) AS b FROM z WHERE forward IS NOT NULL),
ic AS MATERIALIZED (SELECT * FROM (SELECT fid, date, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic FROM icr GROUP BY fid, date HAVING count(*) >= 5) WHERE ic IS NOT NULL),
ed AS ({" UNION ALL ".join(f"SELECT fid, date, {n} AS n, list_distinct(quantile_cont(x, {[i / n for i in range(n + 1)]})) AS e FROM z GROUP BY fid, date" for n in GRID["groups"])}),
lab AS (SELECT z.*, n, greatest(0, len(list_filter(e, lambda q: q < x)) - 1) AS label FROM z JOIN ed USING (fid, date) WHERE len(e) > 1),
sid AS (SELECT *, CASE WHEN max(label) OVER g = min(label) OVER g THEN 0 WHEN label = max(label) OVER g THEN 1 WHEN label = min(label) OVER g THEN -1 ELSE 0 END AS s FROM lab WINDOW g AS (PARTITION BY fid, date, n)),
wt AS MATERIALIZED (SELECT gid, code, date, forward, s * 1.0 / count(*) OVER (PARTITION BY gid, date, s) AS weight FROM sid JOIN {_CANDIDATES} ON c.fid = sid.fid AND c.n = sid.n WHERE s <> 0),
er AS (SELECT gid, next AS date, sum(weight * coalesce(forward, 0)) AS ret FROM wt JOIN cal USING (date) WHERE next IS NOT NULL GROUP BY 1, 2),
mv AS (SELECT gid, code, date, sum(d) AS d FROM (SELECT gid, code, date, weight AS d FROM wt UNION ALL SELECT gid, code, next, -weight FROM wt JOIN cal USING (date) WHERE next IS NOT NULL) GROUP BY 1, 2, 3),
tn AS (SELECT gid, date, sum(abs(d)) / 2 AS turnover FROM mv GROUP BY 1, 2),
daily AS MATERIALIZED (SELECT coalesce(er.gid, tn.gid) AS gid, coalesce(er.date, tn.date) AS date, ret, turnover FROM er FULL JOIN tn ON er.gid = tn.gid AND er.date = tn.date)"""


def _scores_sql(slices: str, suffix: str = "") -> str:
    """CTE `sc{suffix}` with the scores over the windows of the table `slices` (window, date)."""
    s = suffix
    return f"""ins{s} AS (SELECT gid, w, date, ret, turnover, exp(sum(ln(1 + greatest(coalesce(ret, 0), -0.999999))) OVER (PARTITION BY gid, w ORDER BY date)) AS nav FROM daily JOIN {slices} USING (date)),
fal{s} AS (SELECT *, nav / greatest(1, max(nav) OVER (PARTITION BY gid, w ORDER BY date)) - 1 AS fall FROM ins{s}),
mon{s} AS (SELECT gid, w, count(ret) AS n_bars, arg_max(nav, date) AS e, avg(ret) AS m, stddev_samp(ret) AS sd, min(fall) AS max_drawdown, avg(turnover) AS turnover FROM fal{s} GROUP BY 1, 2),
icm{s} AS (SELECT fid, w, date_trunc('month', date) AS mo, avg(ic) AS ic, sum(ic) AS su, count(*) AS n FROM ic JOIN {slices} USING (date) GROUP BY 1, 2, 3),
icd{s} AS (SELECT *, quantile_cont(ic, 0.5) OVER (PARTITION BY fid, w) AS med FROM icm{s}),
icw{s} AS (SELECT fid, w, sum(n) AS ic_sections, sum(su) / sum(n) AS mean_ic, max(med) - 0.25 * 1.4826 * quantile_cont(abs(ic - med), 0.5) AS robust_ic FROM icd{s} GROUP BY 1, 2),
sc{s} AS (SELECT m.gid, m.w, n_bars, pow(e, {YEAR} / nullif(n_bars, 0)) - 1 AS annual, sd * sqrt({YEAR}) AS volatility, m / nullif(sd, 0) * sqrt({YEAR}) AS sharpe, max_drawdown, (pow(e, {YEAR} / nullif(n_bars, 0)) - 1) / nullif(-max_drawdown, 0) AS calmar, turnover, ic_sections, mean_ic, robust_ic
  FROM mon{s} m JOIN {_CANDIDATES} USING (gid) LEFT JOIN icw{s} i ON i.fid = c.fid AND i.w = m.w)"""


_COLUMNS = ", ".join(R(c, c) for c in ("annual", "volatility", "sharpe", "max_drawdown", "calmar", "turnover", "mean_ic", "robust_ic"))


def _slices_sql(length: int, step: int, name: str, first: int = 0, size: int | None = None) -> str:
    size = size or length
    return f"{name} AS (SELECT CAST(w AS INTEGER) AS w, date FROM cal, (SELECT unnest(range(0, 1000)) AS w) WHERE w * {step} + {length} <= n AND i - w * {step} >= {first} AND i - w * {step} < {first + size})"


@query(f"""{_SWEEP}, {_slices_sql(36, 12, 'slc')}, {_scores_sql('slc')}
SELECT gid, w AS "window", n_bars, CAST(ic_sections AS BIGINT) AS ic_sections, {_COLUMNS} FROM sc""")
def sweep_candidates(spark, sf_dir):
    """24 candidates over rolling windows of 36 bars: each computed once, sliced per window."""
    candidates, daily, ic, calendar = _evaluated(spark, sf_dir)
    return neat(sweep.scores(daily, ic, candidates, sweep.window_dates(calendar, 36, 12), YEAR), "gid", "window")


@query(f"""{_SWEEP}, one AS (SELECT 0 AS w, date FROM cal), {_scores_sql('one')}, o AS (SELECT *, row_number() OVER (ORDER BY round(sharpe, 9) DESC NULLS LAST, gid) AS place FROM sc)
SELECT CAST(place AS INTEGER) AS place, gid, lookback, skip, groups, n_bars, CAST(ic_sections AS BIGINT) AS ic_sections, {_COLUMNS}
FROM o JOIN (VALUES {", ".join(str((i, *v)) for i, v in enumerate((b, s, n) for b in GRID["lookback"] for s in GRID["skip"] for n in GRID["groups"]))}) g(gid, lookback, skip, groups) USING (gid)""")
def sweep_run(spark, sf_dir):
    """The grid over the whole span, in order of the objective."""
    candidates, daily, ic, calendar = _evaluated(spark, sf_dir)
    found = sweep.scores(daily, ic, candidates, calendar.select(F.lit(0).alias("window"), "date"), YEAR).drop("window")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("sharpe", 9)), "gid"))  # one row a candidate
    named = found.withColumn("place", place).join(selection.grid(spark, GRID).withColumn("gid", F.col("gid").cast("int")), "gid")
    return neat(named.withColumns({k: F.col(k).cast("int") for k in GRID}), "place", "gid", *GRID)


@query(f"""{_SWEEP}, {_slices_sql(36, 12, 'trn', 0, 24)}, {_slices_sql(36, 12, 'tst', 24, 12)}, {_scores_sql('trn', '1')}, {_scores_sql('tst', '2')},
b AS (SELECT w, gid, sharpe, row_number() OVER (PARTITION BY w ORDER BY round(sharpe, 9) DESC, gid) AS k FROM sc1 WHERE sharpe IS NOT NULL)
SELECT b.w AS "window", b.gid, {R('b.sharpe', 'train_sharpe')}, {R('sc2.sharpe', 'test_sharpe')} FROM b LEFT JOIN sc2 ON sc2.w = b.w AND sc2.gid = b.gid WHERE k = 1""")
def walk_forward_run(spark, sf_dir):
    """Champions of 24 training bars on the 12 bars that follow."""
    candidates, daily, ic, calendar = _evaluated(spark, sf_dir)
    slices = sweep.window_dates(calendar, 36, 12)
    score = lambda part: sweep.scores(daily, ic, candidates, slices.where(part), YEAR).withColumn("sharpe", F.round("sharpe", 9))
    return neat(sweep.paired(score("place < 24"), score("place >= 24"), "sharpe"), "window", "gid")
