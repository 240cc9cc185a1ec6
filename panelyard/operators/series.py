"""Performance of many value series at once: (series, date, value) rows in, one row or one column per measure out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def _over(series: str, date: str):
    return Window.partitionBy(series).orderBy(date)


def returns(df: DataFrame, value: str = "nav", series: str = "code", date: str = "date", periods: int = 1) -> DataFrame:
    return df.withColumn("ret", F.try_divide(F.col(value), F.lag(value, periods).over(_over(series, date))) - 1)


def drawdown(df: DataFrame, value: str = "nav", series: str = "code", date: str = "date") -> DataFrame:
    peak = F.max(value).over(_over(series, date).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", F.try_divide(F.col(value), peak) - 1)


def cumulative(df: DataFrame, ret: str = "ret", series: str = "code", date: str = "date", name: str = "nav") -> DataFrame:
    """The compounded growth of returns above -1; NULL returns count as 0."""
    return df.withColumn(name, F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(_over(series, date).rowsBetween(Window.unboundedPreceding, 0))))


def compounded(ret: Column) -> Column:
    """The compounded return of a group's rows, for any returns above -1."""
    return F.exp(F.sum(F.log1p(ret))) - 1


def summary(df: DataFrame, value: str = "nav", series: str = "code", date: str = "date") -> DataFrame:
    """One row a series: return, risk, drawdown and tail measures.

    Annual figures use 252 points a year; downside deviation is that of negative returns alone; the drawdown length is
    the longest run of points below an earlier peak."""
    df = drawdown(returns(df, value, series, date), value, series, date)
    w = _over(series, date)
    run = F.sum((F.col("drawdown") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__run", run).withColumn("__length", F.sum((F.col("drawdown") < 0).cast("int")).over(Window.partitionBy(series, "__run")))
    df = df.withColumn("__q", F.percentile("ret", F.lit(0.05)).over(Window.partitionBy(series)))
    r = F.col("ret")
    base = df.groupBy(series).agg(
        F.count(value).alias("n"), (F.try_divide(F.max_by(value, date), F.min_by(value, date)) - 1).alias("total"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
        F.min("drawdown").alias("max_drawdown"), F.sqrt(F.avg(F.pow("drawdown", F.lit(2.0)))).alias("ulcer"), F.avg(F.abs("drawdown")).alias("pain"), F.max("__length").alias("longest_drawdown"),
        F.stddev_samp(F.when(r < 0, r)).alias("downside"), F.max("__q").alias("var_5"), F.avg(F.when(r <= F.col("__q"), r)).alias("cvar_5"),
        F.try_divide(F.count_if(r > 0), F.count(r)).alias("win_rate"), F.try_divide(F.avg(F.when(r > 0, r)), -F.avg(F.when(r < 0, r))).alias("payoff"),
    )
    annual = F.pow(1 + F.col("total"), F.lit(float(DAYS)) / F.col("n")) - 1
    year = F.sqrt(F.lit(float(DAYS)))
    return base.select(
        series, "n", "total", annual.alias("annual"), (F.col("std") * year).alias("volatility"), (F.try_divide("mean", F.nullif("std", F.lit(0.0))) * year).alias("sharpe"),
        "max_drawdown", F.try_divide(annual, F.nullif(-F.col("max_drawdown"), F.lit(0.0))).alias("calmar"), "ulcer", F.try_divide(annual, F.nullif("ulcer", F.lit(0.0))).alias("martin"),
        "pain", F.try_divide(annual, F.nullif("pain", F.lit(0.0))).alias("pain_ratio"), "longest_drawdown", "downside",
        (F.try_divide("mean", F.nullif("downside", F.lit(0.0))) * year).alias("sortino"), "var_5", "cvar_5", "win_rate", "payoff",
    )


def rolling(df: DataFrame, n: int, series: str = "code", date: str = "date", ret: str = "ret") -> DataFrame:
    """Rolling win rate and Sharpe ratio of n returns."""
    w = _over(series, date).rowsBetween(-(n - 1), 0)
    full = F.count(ret).over(w) == n
    return df.withColumn("win_rate", F.when(full, F.avg((F.col(ret) > 0).cast("double")).over(w))).withColumn("sharpe", F.when(full, F.try_divide(F.avg(ret).over(w), F.nullif(F.stddev_samp(ret).over(w), F.lit(0.0))) * F.sqrt(F.lit(float(DAYS)))))


def against(df: DataFrame, ret: str, benchmark: str, series: str = "code") -> DataFrame:
    """Beta, alpha (annual), tracking error, information ratio and the share of wins over a benchmark column."""
    r, b = F.col(ret), F.col(benchmark)
    both = df.where(r.isNotNull() & b.isNotNull()).groupBy(series).agg(F.covar_samp(r, b).alias("cov"), F.var_samp(b).alias("var"), F.avg(r).alias("mean"), F.avg(b).alias("bench"), F.stddev_samp(r - b).alias("te"), F.avg((r > b).cast("double")).alias("win"))
    beta = F.try_divide("cov", F.nullif("var", F.lit(0.0)))
    return both.select(
        series, beta.alias("beta"), ((F.col("mean") - beta * F.col("bench")) * DAYS).alias("alpha"), (F.col("te") * F.sqrt(F.lit(float(DAYS)))).alias("tracking_error"),
        (F.try_divide(F.col("mean") - F.col("bench"), F.nullif("te", F.lit(0.0))) * F.sqrt(F.lit(float(DAYS)))).alias("information_ratio"), F.col("win").alias("win_share"),
    )


def turnover(weights: DataFrame, date: str = "date", portfolio: str | None = None) -> DataFrame:
    """Half the sum of absolute weight changes at each rebalance, the first one from nothing. weights has a row for
    every code at every rebalance."""
    keys = [portfolio] if portfolio else []
    before = F.coalesce(F.lag("weight").over(Window.partitionBy(*keys, "code").orderBy(date)), F.lit(0.0))
    return weights.withColumn("__d", F.abs(F.col("weight") - before)).groupBy(*keys, date).agg((F.sum("__d") / 2).alias("turnover"))


def concentration(weights: DataFrame, date: str = "date") -> DataFrame:
    """Holdings, and the Herfindahl index of absolute weights, by date."""
    share = F.abs("weight") / F.sum(F.abs("weight")).over(Window.partitionBy(date))
    return weights.where("weight != 0").withColumn("__s", share).groupBy(date).agg(F.count("*").alias("holdings"), F.sum(F.col("__s") * F.col("__s")).alias("hhi"))


def monthly_table(df: DataFrame, value: str = "nav", series: str = "code", date: str = "date") -> DataFrame:
    """(series, year, month, ret): month-end over the month-end before it; month 0 is the whole year."""
    ends = df.groupBy(series, F.date_trunc("month", date).alias("__m")).agg(F.max_by(value, date).alias("v"), F.min_by(value, date).alias("f"))
    w = Window.partitionBy(series).orderBy("__m")
    months = ends.select(series, F.year("__m").alias("year"), F.month("__m").alias("month"), (F.try_divide("v", F.coalesce(F.lag("v").over(w), F.col("f"))) - 1).alias("ret"))
    years = months.groupBy(series, "year").agg(compounded(F.col("ret")).alias("ret")).select(series, "year", F.lit(0).alias("month"), "ret")
    return months.unionByName(years)


def annual_turnover(turnovers: DataFrame, date: str = "date") -> DataFrame:
    """One row: the mean turnover of a rebalance, and that of a year at the mean gap between rebalances."""
    a = turnovers.agg(F.count("*").alias("rebalances"), F.avg("turnover").alias("mean"), F.datediff(F.max(date), F.min(date)).alias("__d"))
    gap = F.try_divide(F.col("__d").cast("double"), F.col("rebalances") - 1)
    return a.select("rebalances", "mean", F.try_divide(F.col("mean") * 365, gap).alias("annual"))


def rolling_drawdown(df: DataFrame, n: int, value: str = "nav", series: str = "code", date: str = "date") -> DataFrame:
    """Adds the deepest fall from an earlier peak within the last n rows (NULL before there are n): the window's values fold
    into (peak, fall), n numbers at most."""
    w = _over(series, date).rowsBetween(-(n - 1), 0)
    held = F.collect_list(F.col(value).cast("double")).over(w)
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("fall"))

    def step(s: Column, v: Column) -> Column:
        peak = F.greatest(s["peak"], v)
        return F.struct(peak.alias("peak"), F.least(s["fall"], F.coalesce(F.try_divide(v, peak) - 1, F.lit(0.0))).alias("fall"))

    return df.withColumn("rolling_drawdown", F.when(F.count(value).over(w) == n, F.aggregate(held, start, step, lambda s: s["fall"])))
