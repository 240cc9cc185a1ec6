"""Cross-sections: cleaning, neutralising, quantile groups, weights, and tables of groups. All partition by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(date: str):
    return Window.partitionBy(date)


def winsorize(df: DataFrame, x: str, method: str = "mad", n: float = 3.0, date: str = "date") -> DataFrame:
    """Clips x by date: mad (median and raw median deviation), percentile (n and 100 - n per cent), or std."""
    w = _by(date)
    if method == "mad":
        df = df.withColumn("__m", F.percentile(x, F.lit(0.5)).over(w)).withColumn("__s", F.percentile(F.abs(F.col(x) - F.col("__m")), F.lit(0.5)).over(w))
        low, high = F.col("__m") - n * F.col("__s"), F.col("__m") + n * F.col("__s")
    elif method == "percentile":
        df = df.withColumn("__m", F.percentile(x, F.lit(n / 100)).over(w)).withColumn("__s", F.percentile(x, F.lit(1 - n / 100)).over(w))
        low, high = F.col("__m"), F.col("__s")
    elif method == "std":
        df = df.withColumn("__m", F.avg(x).over(w)).withColumn("__s", F.stddev_samp(x).over(w))
        low, high = F.col("__m") - n * F.col("__s"), F.col("__m") + n * F.col("__s")
    else:
        raise ValueError(method)
    value = F.col(x)
    clipped = F.when(value < low, low).when(value > high, high).otherwise(value)
    return df.withColumn(x, F.when(value.isNotNull(), clipped)).drop("__m", "__s")


def pct_rank(x: str, date: str = "date") -> Column:
    """Rank among the non-NULL values of the date, ties averaged, over their number."""
    own = Window.partitionBy(date, F.col(x).isNull())
    ties = own.orderBy(x).rangeBetween(Window.currentRow, Window.currentRow)
    place = F.rank().over(own.orderBy(x)) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return F.when(F.col(x).isNotNull(), place / F.count(F.lit(1)).over(own))


def standardize(df: DataFrame, x: str, method: str = "zscore", date: str = "date") -> DataFrame:
    """zscore, rank or minmax by date; 0 where the values don't differ."""
    w, value = _by(date), F.col(x)
    if method == "zscore":
        out = F.coalesce(F.try_divide(value - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))), F.lit(0.0))
    elif method == "rank":
        return df.withColumn(x, pct_rank(x, date))
    elif method == "minmax":
        low, high = F.min(x).over(w), F.max(x).over(w)
        out = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    else:
        raise ValueError(method)
    return df.withColumn(x, F.when(value.isNotNull(), out))


def neutralize(df: DataFrame, y: str, group: str | None = None, control: str | None = None, date: str = "date") -> DataFrame:
    """The residual of y on group dummies and one control, with a constant, by date.

    By Frisch, Waugh and Lovell: what is left after demeaning within (date, group) regresses on what is left of the
    control. Dates of fewer rows than regressors + 5 keep y. A NULL group falls in with the first one by order."""
    used = F.col(y).isNotNull() & (F.col(control).isNotNull() if control else F.lit(True))
    day = _by(date)
    df = df.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.min(F.when(used, F.col(group).cast("string"))).over(day), F.lit("")) if group else F.lit(""))
    df = df.withColumn("__u", used)
    cell = Window.partitionBy(date, "__g", "__u")
    df = df.withColumn("__y", F.col(y) - F.avg(y).over(cell))
    k = F.size(F.collect_set(F.when(F.col("__u"), F.col("__g"))).over(day)) + (1 if control else 0)
    df = df.withColumn("__n", F.sum(F.col("__u").cast("int")).over(day)).withColumn("__k", k)
    residual = F.col("__y")
    if control:
        df = df.withColumn("__x", F.when(F.col("__u"), F.col(control) - F.avg(control).over(cell)))
        slope = F.try_divide(F.sum(F.when(F.col("__u"), F.col("__x") * F.col("__y"))).over(day), F.sum(F.col("__x") * F.col("__x")).over(day))
        df = df.withColumn("__b", F.coalesce(slope, F.lit(0.0)))
        residual = F.col("__y") - F.col("__b") * F.col("__x")
    out = F.when(F.col("__u"), F.when(F.col("__n") < F.col("__k") + 5, F.col(y)).otherwise(residual))
    return df.withColumn(y, out).drop("__g", "__u", "__y", "__n", "__k", "__x", "__b")


def quantile_label(df: DataFrame, x: str, n: int, name: str = "label", by: tuple[str, ...] = ("date",)) -> DataFrame:
    """0-based quantile group of x, with linear quantiles whose repeats are dropped; NULL where all values agree."""
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)])).over(Window.partitionBy(*by)))
    df = df.withColumn("__e", edges)
    below = F.size(F.filter("__e", lambda e: e < F.col(x)))
    return df.withColumn(name, F.when(F.col(x).isNotNull() & (F.size("__e") > 1), F.greatest(F.lit(0), below - 1))).drop("__e")


def double_sort(df: DataFrame, first: str, second: str, n: int, m: int, dependent: bool = False, date: str = "date") -> DataFrame:
    """label_1 and label_2; the second within the first's groups if dependent. Rows need both values."""
    both = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    one = quantile_label(both, first, n, "label_1", (date,))
    return quantile_label(one, second, m, "label_2", (date, "label_1") if dependent else (date,))


def long_short_weights(df: DataFrame, label: str = "label", date: str = "date") -> DataFrame:
    """Equal weights of 1 on the top group and -1 on the bottom one, by date; other rows 0."""
    w = _by(date)
    df = df.withColumn("__t", F.max(label).over(w)).withColumn("__b", F.min(label).over(w))
    side = F.when(F.col("__t") == F.col("__b"), 0).when(F.col(label) == F.col("__t"), 1).when(F.col(label) == F.col("__b"), -1).otherwise(0)
    df = df.withColumn("__s", side)
    return df.withColumn("weight", F.coalesce(F.try_divide(F.col("__s").cast("double"), F.count("*").over(Window.partitionBy(date, "__s")).cast("double")), F.lit(0.0))).drop("__t", "__b", "__s")


def factor_weights(df: DataFrame, x: str, long: list[int], short: list[int], label: str = "label", date: str = "date") -> DataFrame:
    """Weights in proportion to x, shifted so that the least of a side is 0 (for the short side to its negative), 1 and
    -1 a side; equal where a side's values agree."""
    side = F.when(F.col(label).isin(long), 1).when(F.col(label).isin(short), -1).otherwise(0)
    df = df.withColumn("__s", side).withColumn("__v", F.coalesce(F.col(x), F.lit(0.0)) * F.when(F.col("__s") < 0, -1).otherwise(1))
    w = Window.partitionBy(date, "__s")
    df = df.withColumn("__v", F.col("__v") - F.min("__v").over(w))
    share = F.coalesce(F.try_divide(F.col("__v"), F.nullif(F.sum("__v").over(w), F.lit(0.0))), F.lit(1.0) / F.count("*").over(w))
    return df.withColumn("weight", F.col("__s") * share).drop("__s", "__v")


def with_cash(weights: DataFrame, date: str = "date") -> DataFrame:
    """Sides that sum to more than 1 are scaled to 1; what the weights leave is the code `cash`."""
    w = _by(date)
    long, short = F.sum(F.greatest("weight", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).over(w)
    scaled = weights.select(date, F.col("code").cast("string").alias("code"), F.when(F.col("weight") > 0, F.col("weight") / F.greatest(long, F.lit(1.0))).otherwise(F.col("weight") / F.greatest(short, F.lit(1.0))).alias("weight"))
    cash = scaled.groupBy(date).agg((1 - F.sum("weight")).alias("weight")).select(date, F.lit("cash").alias("code"), "weight")
    return scaled.unionByName(cash)


def industry_weights(df: DataFrame, side: str, group: str, date: str = "date") -> DataFrame:
    """Equal per industry of a side, and equal within an industry; a missing industry is one of its own."""
    df = df.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("__other__")))
    groups = F.size(F.collect_set("__g").over(Window.partitionBy(date, side)))
    inside = F.count("*").over(Window.partitionBy(date, side, "__g"))
    return df.withColumn("weight", F.col(side) / (groups * inside)).drop("__g")


def group_table(df: DataFrame, label: str, x: str, date: str = "date") -> DataFrame:
    """Count and mean of x by date and label, with totals of either and of both (NULL keys stand for totals)."""
    return df.where(F.col(label).isNotNull()).cube(date, label).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))


def label_tables(df: DataFrame, labels: list[str], values: list[str]) -> DataFrame:
    """Count and means over every combination of labels, with the margins; a missing label is 0, a margin `all`."""
    table = df.cube(*labels).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values), *(F.grouping(c).alias(f"__{c}") for c in labels))
    return table.withColumns({c: F.when(F.col(f"__{c}") == 1, "all").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("0"))) for c in labels}).drop(*(f"__{c}" for c in labels))


def group_statistics(df: DataFrame, label: str, x: str, date: str = "date") -> DataFrame:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.where(F.col(label).isNotNull()).groupBy(date, label).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), q.alias("q"), F.max(x).alias("high"))
    return out.select(date, label, "n", "mean", "std", "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "high")


def equal_weights(df: DataFrame, price: str, date: str = "date") -> DataFrame:
    """The same weight for each code that has a price on the date, 0 for the others."""
    there = F.col(price).isNotNull().cast("int")
    return df.withColumn("weight", F.coalesce(F.try_divide(there, F.sum(there).over(_by(date))), F.lit(0.0)))
