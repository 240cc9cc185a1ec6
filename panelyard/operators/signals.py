"""How well signals and factors foretell, over time and across codes, beyond the plain coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.distributions import t_p_value
from panelyard.operators.cross_section import quantile_label
from panelyard.operators.evaluation import guarded_corr
from panelyard.operators.grades import WEIGHTS, graded


def timing_ic(df: DataFrame, x: str, ret: str, ahead: int, window: int, code: str = "code", date: str = "date") -> DataFrame:
    """(code, date, ic): correlation over the last `window` bars of x with the sum of the next `ahead` returns."""
    w = Window.partitionBy(code).orderBy(date)
    nexts = w.rowsBetween(1, ahead)
    df = df.withColumn("__f", F.when(F.count(ret).over(nexts) == ahead, F.sum(ret).over(nexts))).where(F.col(x).isNotNull() & F.col("__f").isNotNull())
    past = w.rowsBetween(-(window - 1), 0)
    spread = F.stddev_pop(x).over(past) * F.stddev_pop("__f").over(past)
    return df.select(code, date, F.when((F.count("*").over(past) == window) & (spread > 1e-12), F.covar_pop(x, "__f").over(past) / spread).alias("ic"))


def signal_test(df: DataFrame, signal: str, ret: str, by: list[str]) -> DataFrame:
    """Of signals 1 and -1 against the returns that follow: counts, hit rates, means, their spread and Welch's t."""
    r, up, down = F.col(ret), F.col(signal) > 0, F.col(signal) < 0
    a = df.where(r.isNotNull() & F.col(signal).isNotNull()).groupBy(*by).agg(
        F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), F.count_if(up & (r > 0)).alias("__hu"), F.count_if(down & (r < 0)).alias("__hd"),
        F.avg(F.when(up, r)).alias("mean_up"), F.avg(F.when(down, r)).alias("mean_down"), F.var_samp(F.when(up, r)).alias("__vu"), F.var_samp(F.when(down, r)).alias("__vd"),
    )
    spread = F.col("mean_up") - F.col("mean_down")
    error = F.sqrt(F.try_divide("__vu", "n_up") + F.try_divide("__vd", "n_down"))
    return a.select(
        *by, "n_up", "n_down", F.try_divide("__hu", "n_up").alias("hit_up"), F.try_divide("__hd", "n_down").alias("hit_down"), F.try_divide(F.col("__hu") + F.col("__hd"), F.col("n_up") + F.col("n_down")).alias("hit"),
        "mean_up", "mean_down", spread.alias("spread"), F.try_divide(spread, F.nullif(error, F.lit(0.0))).alias("welch_t"),
    )


def split(df: DataFrame, ratio: float, code: str = "code", date: str = "date") -> DataFrame:
    """Adds `sample`: `in` for the first share of each code's bars, `out` for the rest."""
    place = F.row_number().over(Window.partitionBy(code).orderBy(date))
    return df.withColumn("sample", F.when(place <= F.count("*").over(Window.partitionBy(code)) * ratio, "in").otherwise("out"))


def regression(df: DataFrame, y: str, x: str, by: list[str], least: int = 10) -> DataFrame:
    """alpha, beta, t of beta, r2, adjusted r2 and F of y on x, by group."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = both.groupBy(*by).agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("c"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my")).where(F.col("n") >= least)
    a = a.withColumn("beta", F.try_divide("c", F.nullif("vx", F.lit(0.0)))).withColumn("r2", F.try_divide(F.col("c") * F.col("c"), F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0))))
    f = F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2"))
    return a.select(*by, "n", (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), "beta", (F.signum("beta") * F.sqrt(f)).alias("t"), "r2", (1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adj_r2"), f.alias("f"))


def monotonicity(df: DataFrame, label: str, ret: str, by: list[str]) -> DataFrame:
    """(by, groups, rho, monotone): rank correlation of the groups' mean returns with their order."""
    means = df.where(F.col(label).isNotNull() & F.col(ret).isNotNull()).groupBy(*by, F.col(label).alias("__l")).agg(F.avg(ret).alias("__m"))
    w = Window.partitionBy(*by)
    ranked = means.withColumn("__r", F.rank().over(w.orderBy("__m")) + (F.count("*").over(Window.partitionBy(*by, "__m")) - 1) / 2.0)
    rho = guarded_corr("__l", "__r")
    return ranked.groupBy(*by).agg(F.count("*").alias("groups"), rho.alias("rho"), (F.abs(rho) > 0.8).alias("monotone"))


def ranked_groups(df: DataFrame, x: str, n: int, code: str = "code", date: str = "date") -> DataFrame:
    """Quantile groups of equal size: ties of x go by code, so that no edge repeats."""
    place = F.row_number().over(Window.partitionBy(date).orderBy(F.round(x, 10), code)).cast("double")
    return quantile_label(df.where(F.col(x).isNotNull()).withColumn("__r", place), "__r", n, "label", (date,)).drop("__r")


def robust_ic(ic: DataFrame, shrink: float = 0.25, date: str = "date") -> DataFrame:
    """One row: months, and the median of their mean coefficients less a share of their scaled absolute deviation."""
    months = ic.groupBy(F.date_trunc("month", date).alias("__m")).agg(F.avg("ic").alias("ic")).where("ic is not null")
    middle = months.agg(F.percentile("ic", F.lit(0.5)).alias("__med"))
    spread = months.join(F.broadcast(middle)).agg(F.count("*").alias("months"), F.max("__med").alias("median"), F.percentile(F.abs(F.col("ic") - F.col("__med")), F.lit(0.5)).alias("__mad"))
    return spread.select("months", "median", (F.col("median") - shrink * 1.4826 * F.col("__mad")).alias("robust"))


def outliers(df: DataFrame, x: str, k: float, date: str = "date") -> DataFrame:
    """(date, n, outside, share): values more than k median absolute deviations from the date's median."""
    w = Window.partitionBy(date)
    df = df.where(F.col(x).isNotNull()).withColumn("__m", F.percentile(x, F.lit(0.5)).over(w))
    df = df.withColumn("__d", F.percentile(F.abs(F.col(x) - F.col("__m")), F.lit(0.5)).over(w))
    found = df.groupBy(date).agg(F.count("*").alias("n"), F.count_if(F.round(F.abs(F.col(x) - F.col("__m")) - k * F.col("__d"), 9) > 0).alias("outside"))
    return found.withColumn("share", F.col("outside") / F.col("n"))


def long_factors(df: DataFrame, factors: list[str], code: str = "code", date: str = "date") -> DataFrame:
    """(code, date, factor, x)."""
    parts = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])
    return df.select(code, date, F.explode(parts).alias("p")).select(code, date, "p.*").where("x is not null")


def pair_correlations(df: DataFrame, factors: list[str], least: int = 5, date: str = "date") -> DataFrame:
    """(date, a, b, n, corr): linear correlation across codes of each pair of factors on each date."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    long = df.select(date, F.explode(parts).alias("p")).select(date, "p.*").where("x is not null and y is not null")
    return long.groupBy(date, "a", "b").agg(F.count("*").alias("n"), guarded_corr("x", "y").alias("corr")).where(F.col("n") >= least)


def selection_coincidence(df: DataFrame, factors: list[str], quantile: float = 0.8, date: str = "date", code: str = "code") -> DataFrame:
    """(a, b, dates, jaccard): how much the codes at or above a quantile of one factor are those of another, on average."""
    long = long_factors(df, factors, code, date)
    chosen = long.withColumn("__e", F.percentile("x", F.lit(quantile)).over(Window.partitionBy(date, "factor"))).where("x >= __e").select(date, code, "factor")
    per_code = chosen.groupBy(date, code).agg(F.sort_array(F.collect_set("factor")).alias("f"))
    size = chosen.groupBy(date, "factor").agg(F.count("*").alias("n"))
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    both = per_code.select(date, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.array_contains("f", a) & F.array_contains("f", b)).alias("hit")) for a, b in pairs])).alias("p"))
    common = both.groupBy(date, "p.a", "p.b").agg(F.count_if("p.hit").alias("common"))
    sized = common.join(size.select(date, F.col("factor").alias("a"), F.col("n").alias("na")), [date, "a"]).join(size.select(date, F.col("factor").alias("b"), F.col("n").alias("nb")), [date, "b"])
    return sized.groupBy("a", "b").agg(F.count("*").alias("dates"), F.avg(F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def redundant_groups(pairs: DataFrame, factors: DataFrame, least: float, steps: int) -> DataFrame:
    """(factor, leader): factors linked by a correlation of at least `least` share the first name that links reach.
    steps: how often names are handed on; as many as there are factors is always enough."""
    near = pairs.where(F.abs("mean") >= least)
    links = near.select("a", "b").union(near.select("b", "a"))
    named = factors.withColumn("leader", F.col("factor"))
    for _ in range(steps):
        heard = links.join(named, links.b == named.factor).groupBy("a").agg(F.min("leader").alias("heard"))
        named = named.join(heard, named.factor == heard.a, "left").select("factor", F.least("leader", "heard").alias("leader"))
    return named


def threshold_weights(df: DataFrame, x: str, threshold: float, above: bool = True, side: int = 1, most: float = 1.0) -> DataFrame:
    """weight: the side's full weight where x is beyond the threshold, else 0; executed ten minutes later."""
    active: Column = F.col(x) > threshold if above else F.col(x) < threshold
    return df.withColumn("weight", F.when(F.coalesce(active, F.lit(False)), side * most).otherwise(0.0)).withColumn("execute_at", F.to_timestamp("date") + F.expr("INTERVAL 10 MINUTES"))


def single_factor_tests(df: DataFrame, y: str, x: str, factor: str) -> DataFrame:
    """(factor, n, beta, abs_t) of y on each factor alone."""
    return regression(df, y, x, [factor], 3).select(factor, "n", "beta", F.abs("t").alias("abs_t"))


def horizons(df: DataFrame, price: str, bars: list[int], code: str = "code", date: str = "date") -> DataFrame:
    """Each row once for each horizon, with the return over that many bars."""
    w = Window.partitionBy(code).orderBy(date)
    parts = F.array(*[F.struct(F.lit(k).alias("horizon"), (F.try_divide(F.lead(price, k).over(w), F.col(price)) - 1).alias("forward")) for k in bars])
    return df.withColumn("__h", parts).withColumn("__h", F.explode("__h")).select("*", "__h.*").drop("__h")


def robustness(ic: DataFrame, by: str = "code") -> DataFrame:
    """(by, mean and icir in and out of sample, decay, robust): robust where both means have one sign and the decay is
    below a half. ic: by, sample (in or out), ic."""
    of = lambda s: F.when(F.col("sample") == s, F.col("ic"))
    a = ic.groupBy(by).agg(F.avg(of("in")).alias("mean_in"), F.stddev_samp(of("in")).alias("__si"), F.avg(of("out")).alias("mean_out"), F.stddev_samp(of("out")).alias("__so"))
    icir = lambda m, s: F.try_divide(m, F.nullif(s, F.lit(0.0)))
    decay = F.try_divide(F.abs(F.col("mean_out") - F.col("mean_in")), F.nullif(F.abs("mean_in"), F.lit(0.0)))
    robust = F.coalesce((F.signum("mean_in") == F.signum("mean_out")) & (F.coalesce(decay, F.lit(0.0)) < 0.5), F.lit(False))
    return a.select(by, "mean_in", icir("mean_in", "__si").alias("icir_in"), "mean_out", icir("mean_out", "__so").alias("icir_out"), decay.alias("decay"), robust.alias("robust"))


def timing_score(ic: DataFrame, tested: DataFrame, fitted: DataFrame, stable: DataFrame, by: str = "code") -> DataFrame:
    """(by, four parts, score, grade A to F); see grades. A part that is missing counts as if its share of hits were 0.3.

    ic: by, icir, hit_rate; tested: by, hit; fitted: by, n, r2, t (a beta counts at p below 0.05); stable: of `robustness`."""
    joined = ic.select(by, "icir", "hit_rate").join(tested.select(by, F.coalesce("hit", F.lit(0.3)).alias("hit")), by, "left").join(fitted.select(by, "r2", t_p_value(F.col("t"), F.col("n") - 2).alias("p_value")), by, "left")
    found = graded(joined.join(stable.select(by, "mean_in", "mean_out", "decay"), by, "left"))
    return found.select(by, *WEIGHTS, "score", "grade")


def window_regressions(df: DataFrame, y: str, x: str, length: int, step: int, code: str = "code", date: str = "date") -> DataFrame:
    """(code, window, n, beta, t, r2) over windows of `length` bars, every `step` bars; a bar belongs to all its windows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__k", F.row_number().over(Window.partitionBy(code).orderBy(date)) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("__k") - (length - 1)) / step)).cast("int")
    placed = both.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("__k") / step).cast("int"))))
    return regression(placed, y, x, [code, "window"], length).select(code, "window", "n", "beta", "t", "r2")
