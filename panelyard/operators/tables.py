"""Tables behind charts: leading codes, holdings with the rest summed, forward returns, histograms, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leading(df: DataFrame, value: str, n: int, code: str = "code") -> DataFrame:
    """The rows of the n codes with the largest absolute value at any time, ties to the smaller code."""
    peak = df.groupBy(code).agg(F.max(F.abs(value)).alias("__p")).orderBy(F.desc_nulls_last("__p"), code).limit(n)
    return df.join(F.broadcast(peak.select(code)), code, "left_semi")


def daily_holdings(weights: DataFrame, n: int, date: str = "date") -> DataFrame:
    """(date, code, weight): the n largest positions of each date; all others as `other`."""
    place = F.row_number().over(Window.partitionBy(date).orderBy(F.desc(F.abs("weight")), "code"))
    return weights.where("weight != 0").withColumn("__n", place).groupBy(date, F.when(F.col("__n") <= n, F.col("code").cast("string")).otherwise("other").alias("code")).agg(F.sum("weight").alias("weight"))


def forward_returns(df: DataFrame, value: str, horizons: list[int], code: str = "code", date: str = "date") -> DataFrame:
    """(code, date, horizon, ret) for each horizon."""
    w = Window.partitionBy(code).orderBy(date)
    df = df.select(code, date, *(F.try_divide(F.lead(value, h).over(w), F.col(value)).alias(f"h{h}") for h in horizons))
    return df.select(code, date, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(f"h{h}") - 1).alias("ret")) for h in horizons])).alias("s")).select(code, date, "s.*").where(F.col("ret").isNotNull())


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal widths between the extremes; the last bin holds the largest value."""
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    placed = df.where(F.col(x).isNotNull()).join(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(x) - F.col("__lo"), width)), F.lit(0))).cast("int"))
    return placed.groupBy("bin").agg((F.first("__lo") + F.col("bin") * F.first(width)).alias("low"), (F.first("__lo") + (F.col("bin") + 1) * F.first(width)).alias("high"), F.count("*").alias("n"))
