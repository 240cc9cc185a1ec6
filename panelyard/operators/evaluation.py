"""How well a factor orders returns: information coefficients, regressions, group returns, stability, redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.cross_section import pct_rank


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation of a group; NULL where either side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / spread)


def information_coefficient(df: DataFrame, factor: str, ret: str, rank: bool = True, least: int = 5, date: str = "date") -> DataFrame:
    """(date, n, ic): correlation of factor and return across codes, of ranks if `rank`, for dates of `least` codes."""
    both = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull()).select(date, factor, ret)
    if rank:
        both = both.withColumns({"__x": pct_rank(factor, date), "__y": pct_rank(ret, date)})
    else:
        both = both.withColumns({"__x": F.col(factor), "__y": F.col(ret)})
    return both.groupBy(date).agg(F.count("*").alias("n"), guarded_corr("__x", "__y").alias("ic")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviation, their ratio, hit rate and t value of a series of coefficients."""
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.groupBy(*by).agg(n.alias("n"), m.alias("mean"), s.alias("std"), F.try_divide(m, F.nullif(s, F.lit(0.0))).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), (F.try_divide(m, F.nullif(s, F.lit(0.0))) * F.sqrt(n)).alias("t"))


def rolling_icir(ic: DataFrame, n: int, date: str = "date") -> DataFrame:
    """A series of coefficients has one row a date, so one window holds it."""
    w = Window.orderBy(date).rowsBetween(-(n - 1), 0)
    return ic.withColumn("icir", F.when(F.count("ic").over(w) == n, F.try_divide(F.avg("ic").over(w), F.nullif(F.stddev_samp("ic").over(w), F.lit(0.0)))))


def forward_return(df: DataFrame, price: str, bars: int = 1, code: str = "code", date: str = "date") -> DataFrame:
    return df.withColumn("forward", F.try_divide(F.lead(price, bars).over(Window.partitionBy(code).orderBy(date)), F.col(price)) - 1)


def cross_regression(df: DataFrame, y: str, x: str, least: int = 10, date: str = "date") -> DataFrame:
    """(date, n, alpha, beta, r2) of the regression of y on x across codes."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = both.groupBy(date).agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("c"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my")).where(F.col("n") >= least)
    beta = F.try_divide("c", F.nullif("vx", F.lit(0.0)))
    return a.select(date, "n", (F.col("my") - beta * F.col("mx")).alias("alpha"), beta.alias("beta"), F.try_divide(F.col("c") * F.col("c"), F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0))).alias("r2"))


def fama_macbeth(df: DataFrame, y: str, x: str, least: int = 10, date: str = "date") -> DataFrame:
    """Mean, deviation and t value of the slopes of each date's regression."""
    b = cross_regression(df, y, x, least, date)
    m, s, n = F.avg("beta"), F.stddev_samp("beta"), F.count("beta")
    return b.agg(n.alias("n"), m.alias("mean"), s.alias("std"), (F.try_divide(m, F.nullif(s, F.lit(0.0))) * F.sqrt(n)).alias("t"))


def group_returns(df: DataFrame, label: str, ret: str, date: str = "date") -> DataFrame:
    """(date, label, ret): mean return of each group; label -1 is the top group less the bottom one."""
    means = df.where(F.col(label).isNotNull()).groupBy(date, F.col(label).alias("label")).agg(F.avg(ret).alias("ret"))
    spread = means.where("ret is not null").groupBy(date).agg((F.max_by("ret", "label") - F.min_by("ret", "label")).alias("ret")).select(date, F.lit(-1).alias("label"), "ret")
    return means.unionByName(spread)


def autocorrelation(df: DataFrame, x: str, lags: list[int], least: int = 5, code: str = "code", date: str = "date") -> DataFrame:
    """(lag, n, mean): mean rank correlation of the factor's cross-sections that many periods apart."""
    ranked = df.where(F.col(x).isNotNull()).select(code, date, F.col(x).alias("__v"))
    dates = ranked.select(date).distinct().withColumn("__p", F.row_number().over(Window.orderBy(date)))
    now = ranked.join(dates, date).select(code, "__p", "__v")
    later = now.select(code, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("__p") + k).alias("__p")) for k in lags])).alias("s"), F.col("__v").alias("__u")).select(code, "s.lag", "s.__p", "__u")
    both = now.join(later, [code, "__p"]).withColumn("__d", F.struct("lag", "__p"))
    return information_coefficient(both, "__v", "__u", True, least, "__d").groupBy(F.col("__d.lag").alias("lag")).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"))


def selection_turnover(df: DataFrame, x: str, quantile: float = 0.8, code: str = "code", date: str = "date") -> DataFrame:
    """(date, n, kept, turnover, jaccard) of the codes at or above a quantile against the period before."""
    edge = F.percentile(x, F.lit(quantile)).over(Window.partitionBy(date))
    chosen = df.where(F.col(x).isNotNull()).withColumn("__e", edge).where(F.col(x) >= F.col("__e")).select(code, date)
    dates = df.where(F.col(x).isNotNull()).select(date).distinct().withColumn("__b", F.lag(date).over(Window.orderBy(date)))
    size = chosen.groupBy(date).agg(F.count("*").alias("n"))
    kept = chosen.join(dates, date).join(chosen.select(code, F.col(date).alias("__b")), [code, "__b"]).groupBy(date).agg(F.count("*").alias("kept"))
    before = size.select(F.col(date).alias("__b"), F.col("n").alias("n_before"))
    out = size.join(dates, date).join(before, "__b").join(kept, date, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.select(date, "n", "kept", (1 - F.col("kept") / F.col("n_before")).alias("turnover"), (F.col("kept") / (F.col("n") + F.col("n_before") - F.col("kept"))).alias("jaccard"))


def distribution(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, moments (skewness and excess kurtosis without bias) and quantiles of x."""
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)]))
    a = df.groupBy(*by).agg(F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), q.alias("q"), F.max(x).alias("high"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return a.select(*by, "n", "missing", "mean", "std", "low", *(F.col("q")[i].alias(name) for i, name in enumerate(("q01", "q25", "median", "q75", "q99"))), "high", skew.alias("skew"), kurt.alias("kurtosis"))


def coverage(df: DataFrame, x: str, date: str = "date", code: str = "code") -> DataFrame:
    """(date, valid, ratio): how many of all codes ever seen have a value."""
    total = df.agg(F.count_distinct(F.when(F.col(x).isNotNull(), F.col(code))).alias("total"))
    return df.groupBy(date).agg(F.count(x).alias("valid")).join(F.broadcast(total)).select(date, "valid", (F.col("valid") / F.col("total")).alias("ratio"))


def factor_correlations(df: DataFrame, factors: list[str], least: int = 5, date: str = "date", code: str = "code") -> DataFrame:
    """(a, b, n, mean) of each pair of factors: the mean over dates of their rank correlation across codes."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(date, F.explode(parts).alias("p")).select(F.struct(date, "p.a", "p.b").alias("k"), "p.x", "p.y")
    return information_coefficient(long, "x", "y", True, least, "k").groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"))
