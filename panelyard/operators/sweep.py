"""Sweeps of parameters in one plan: the candidate is a column, not a job.

Candidates that share a factor share its values, cleaning, ranks and coefficients; candidates that differ in the number of
groups alone read all their quantiles from one window, and stay columns of one row. What is scored is a candidate's series of portfolio returns, one
row a date, which windows then slice: a candidate is computed once, however many windows score it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.cross_section import standardize, winsorize
from panelyard.operators.evaluation import information_coefficient


def exposures(bars: DataFrame, variants: dict[int, Column], price: str, wanted: Column | None = None, code: str = "code", date: str = "date") -> DataFrame:
    """(code, date, fid, x, forward): every variant's value on each bar that has one, and the return until the next bar.
    variants: expressions over a code's history (windows partitioned by code and ordered by date), by number. wanted: the bars
    to give values for (all are looked back on); a bar is left out before its variants become rows."""
    w = Window.partitionBy(code).orderBy(date)
    ahead = bars.withColumn("forward", F.try_divide(F.lead(price).over(w), F.col(price)) - 1)
    parts = F.array(*[F.struct(F.lit(k).alias("fid"), x.cast("double").alias("x")) for k, x in variants.items()])
    valued = ahead.withColumn("__p", parts)
    if wanted is not None:
        valued = valued.where(wanted)
    return valued.select(code, date, "forward", F.explode("__p").alias("p")).select(code, date, "p.*", "forward").where("x IS NOT NULL")


def _keyed(df: DataFrame) -> DataFrame:
    """With factor and date as one key, k."""
    return df.withColumn("k", F.struct("fid", "date"))


def cleaned(values: DataFrame, n: float = 3.0) -> DataFrame:
    """x clipped at n median deviations and standardised, by factor and date."""
    out = standardize(winsorize(_keyed(values), "x", "mad", n, "k"), "x", "zscore", "k")
    return out.withColumn("x", F.round("x", 10)).drop("k")


def coefficients(clean: DataFrame, least: int = 5) -> DataFrame:
    """(fid, date, ic): rank correlation of value and return across codes."""
    return information_coefficient(_keyed(clean).repartition("k"), "x", "forward", True, least, "k").select("k.fid", "k.date", "ic").where("ic IS NOT NULL")


def portfolios(clean: DataFrame, counts: Sequence[int]) -> DataFrame:
    """(fid, code, date, forward, w3, w5, ...): for each number of groups the weight of a row, 1 in equal parts on the top
    group, -1 on the bottom one, else NULL; rows with a weight alone.

    A row's group is the number of distinct edges below it, so the top group lies above the last edge but one and the bottom
    group up to the second; with two edges or one all rows are of one group. All numbers of groups read their edges from one
    window by (factor, date), and their sides' counts from another."""
    w = Window.partitionBy("k")
    counts = sorted(set(counts))
    steps = sorted({i / n for n in counts for i in range(n + 1)})
    out = _keyed(clean).withColumn("__q", F.percentile("x", F.array(*map(F.lit, steps))).over(w))
    edges = {n: F.sort_array(F.array_distinct(F.array(*[F.col("__q")[steps.index(i / n)] for i in range(n + 1)]))) for n in counts}
    bounds = out.withColumns({f"__e{n}": e for n, e in edges.items()})
    side = {n: F.when(F.size(f"__e{n}") > 2, F.when(F.col("x") > F.element_at(f"__e{n}", -2), 1).when(F.col("x") <= F.element_at(f"__e{n}", 2), -1)) for n in counts}
    sided = bounds.select("k", "fid", "code", "date", "forward", *(s.alias(f"__s{n}") for n, s in side.items()))
    sizes = {f"__{s}{n}": F.count(F.when(F.col(f"__s{n}") == v, 1)).over(w) for n in counts for s, v in (("t", 1), ("b", -1))}
    weights = [F.when(F.col(f"__s{n}") == 1, 1.0 / F.col(f"__t{n}")).when(F.col(f"__s{n}") == -1, -1.0 / F.col(f"__b{n}")).alias(f"w{n}") for n in counts]
    weighed = F.coalesce(*(F.col(f"__s{n}") for n in counts)).isNotNull()
    return sided.withColumns(sizes).where(weighed).select("fid", "code", "date", "forward", *weights)


def series(weights: DataFrame, candidates: Sequence[tuple[int, int, int]], calendar: DataFrame) -> DataFrame:
    """(gid, date, ret, turnover): what the weights of the bar before earned on this bar (a price that is missing earns
    nothing), and half the change of weights at this bar. candidates: (gid, fid, number of groups); calendar: date, next.

    A row's change is taken against the code's row of the bar before; a row that none follows on the next bar is also sold
    there. So rows meet by factor and code once, and only sums by factor and date become rows of candidates."""
    counts = sorted({n for _, _, n in candidates})
    w = Window.partitionBy("fid", "code").orderBy("date")
    held = F.lag("next").over(w).eqNullSafe(F.col("date"))
    follows = F.lead("date").over(w).eqNullSafe(F.col("next"))
    dated = weights.join(F.broadcast(calendar), "date").withColumns({"__held": held, "__follows": follows} | {f"__b{n}": F.lag(f"w{n}").over(w) for n in counts})
    none, sums = F.lit(0.0), []
    for n in counts:
        now, before = F.col(f"w{n}"), F.when(F.col("__held"), F.col(f"__b{n}"))
        sums.append(F.sum(now * F.coalesce("forward", none)).alias(f"earned{n}"))
        sums.append(F.sum(F.when(now.isNotNull() | before.isNotNull(), F.abs(F.coalesce(now, none) - F.coalesce(before, none)))).alias(f"changed{n}"))
        sums.append(F.sum(F.when(~F.col("__follows"), F.abs(now))).alias(f"left{n}"))
    moved = dated.groupBy("fid", "date", "next").agg(*sums)
    part = lambda gid, fid, at, ret, move: F.struct(F.lit(gid).alias("gid"), F.lit(fid).alias("of"), F.col(at).alias("date"), ret.cast("double").alias("ret"), move.alias("move"))
    parts = [p for gid, fid, n in candidates for p in (part(gid, fid, "date", F.lit(None), F.col(f"changed{n}")), part(gid, fid, "next", F.col(f"earned{n}"), F.col(f"left{n}")))]
    own = F.filter(F.array(*parts), lambda c: (c["of"] == F.col("fid")) & c["date"].isNotNull() & (c["ret"].isNotNull() | c["move"].isNotNull()))
    return moved.select(F.explode(own).alias("c")).groupBy("c.gid", "c.date").agg(F.sum("c.ret").alias("ret"), (F.sum("c.move") / 2).alias("turnover"))


def next_dates(dates: DataFrame, date: str = "date") -> DataFrame:
    """(date, next) of a calendar."""
    return dates.select(date).distinct().withColumn("next", F.lead(date).over(Window.orderBy(date)))


def window_dates(dates: DataFrame, length: int, step: int, date: str = "date") -> DataFrame:
    """(window, date, place): the dates of every full window of `length` dates, every `step` dates; place from 0."""
    numbered = dates.select(date).distinct().withColumn("__n", F.row_number().over(Window.orderBy(date)) - 1).withColumn("__all", F.count("*").over(Window.partitionBy()))
    first = F.greatest(F.lit(0), F.ceil((F.col("__n") - (length - 1)) / step)).cast("int")
    last = F.least(F.floor(F.col("__n") / step), F.floor((F.col("__all") - length) / step)).cast("int")
    placed = numbered.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    return placed.select("window", date, (F.col("__n") - F.col("window") * step).alias("place"))


def scores(daily: DataFrame, ic: DataFrame, candidates: DataFrame, slices: DataFrame, year: float, shrink: float = 0.25) -> DataFrame:
    """One row for each candidate and window: annual return, volatility, Sharpe, drawdown, Calmar, mean turnover, and the
    mean, robust mean and number of its rank coefficients. candidates: gid, fid; slices: window, date; year: bars a year."""
    inside = daily.join(slices.select("window", "date"), "date").where("ret IS NOT NULL OR turnover IS NOT NULL")
    run = Window.partitionBy("gid", "window").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = inside.withColumn("nav", F.exp(F.sum(F.log1p(F.greatest(F.coalesce("ret", F.lit(0.0)), F.lit(-0.999999)))).over(run)))
    fell = grown.withColumn("fall", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(run)) - 1)
    a = fell.groupBy("gid", "window").agg(
        F.count("ret").alias("n_bars"), F.max_by("nav", "date").alias("__end"), F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"), F.min("fall").alias("max_drawdown"), F.avg("turnover").alias("turnover"))
    annual = F.pow("__end", F.try_divide(F.lit(year), F.col("n_bars"))) - 1
    money = a.select(
        "gid", "window", "n_bars", annual.alias("annual"), (F.col("__s") * year**0.5).alias("volatility"), (F.try_divide("__m", F.nullif("__s", F.lit(0.0))) * year**0.5).alias("sharpe"),
        "max_drawdown", F.try_divide(annual, F.nullif(-F.col("max_drawdown"), F.lit(0.0))).alias("calmar"), "turnover",
    )
    months = ic.join(slices.select("window", "date"), "date").groupBy("fid", "window", F.date_trunc("month", "date").alias("__m")).agg(F.avg("ic").alias("ic"), F.sum("ic").alias("__sum"), F.count("ic").alias("__n"))
    middle = months.withColumn("__med", F.percentile("ic", F.lit(0.5)).over(Window.partitionBy("fid", "window")))
    judged = middle.groupBy("fid", "window").agg(
        F.sum("__n").alias("ic_sections"), (F.sum("__sum") / F.sum("__n")).alias("mean_ic"), (F.max("__med") - shrink * 1.4826 * F.percentile(F.abs(F.col("ic") - F.col("__med")), F.lit(0.5))).alias("robust_ic"))
    return candidates.join(money, "gid").join(judged, ["fid", "window"], "left").drop("fid")


def paired(train: DataFrame, test: DataFrame, objective: str) -> DataFrame:
    """(window, gid, train score, test score): each training window's champion (ties to the smaller id) on the test window
    of the same number."""
    best = train.where(F.col(objective).isNotNull()).groupBy("window").agg(F.max_by("gid", F.struct(objective, -F.col("gid"))).alias("gid"), F.max(objective).alias(f"train_{objective}"))
    return best.join(test.select("window", "gid", F.col(objective).alias(f"test_{objective}")), ["window", "gid"], "left")
