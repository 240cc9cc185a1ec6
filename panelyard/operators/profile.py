"""What a factor's values look like, from counts in a fixed number of bins: the result, and all that is gathered for it, has
the same size whatever the number of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def bins(df: DataFrame, x: str, n: int) -> DataFrame:
    """(side, bin, count, total, low, width, n): counts and sums by bins of equal width of the values (side `x`) and of
    their sizes (side `size`); two passes over the values, the first for their range."""
    v = F.col(x).cast("double")
    finite = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    span = finite.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max(F.abs("v")).alias("c"), F.count("v").alias("n"))
    both = finite.join(F.broadcast(span)).select("n", F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("v"), F.col("a").alias("low"), ((F.col("b") - F.col("a")) / n).alias("width")), F.struct(F.lit("size").alias("side"), F.abs("v").alias("v"), F.lit(0.0).alias("low"), (F.col("c") / n).alias("width")))).alias("s")).select("n", "s.*")  # one row
    at = F.coalesce(F.least(F.lit(n - 1), F.floor(F.try_divide(F.col("v") - F.col("low"), F.nullif(F.col("width"), F.lit(0.0))))), F.lit(0)).cast("int")
    return both.groupBy("side", at.alias("bin"), "low", "width", "n").agg(F.count("*").alias("count"), F.sum("v").alias("total"))


def distribution(binned: DataFrame) -> DataFrame:
    """(value, probability): the share of values up to the end of each bin that has some."""
    up_to = Window.partitionBy("side").orderBy("bin")  # as many rows as bins
    return binned.where("side = 'x'").select((F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("value"), (F.sum("count").over(up_to) / F.col("n")).alias("probability"))


def quantiles(binned: DataFrame, levels: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(quantile, value): where the share is reached, evenly within its bin; off by less than a bin's width."""
    up_to = Window.partitionBy("side").orderBy("bin")
    cum = binned.where("side = 'x'").withColumn("__after", F.sum("count").over(up_to)).withColumn("__q", F.explode(F.array(*map(F.lit, levels))))
    target = F.col("__q") * F.col("n")
    inside = (target > F.col("__after") - F.col("count")) & (target <= F.col("__after"))
    return cum.where(inside).select(F.col("__q").alias("quantile"), (F.col("low") + (F.col("bin") + (target - (F.col("__after") - F.col("count"))) / F.col("count")) * F.col("width")).alias("value"))


def concentration(df: DataFrame, binned: DataFrame, x: str, share: float = 0.1) -> DataFrame:
    """One row: count, missing, mean, deviation, Herfindahl index of the sizes, and the part of all size that the largest
    `share` of values has (the bin in which they end counts at its mean)."""
    v = F.col(x).cast("double")
    whole = df.agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.try_divide(F.sum(v * v), F.nullif(F.sum(F.abs(v)) * F.sum(F.abs(v)), F.lit(0.0))).alias("hhi"))
    down = Window.partitionBy("side").orderBy(F.desc("bin"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    tail = binned.where("side = 'size'").withColumn("__before", F.sum("count").over(down) - F.col("count")).withColumn("__take", F.greatest(F.lit(0), F.least("count", wanted - F.col("__before"))))
    top = tail.agg(F.try_divide(F.sum(F.col("__take") * F.col("total") / F.col("count")), F.nullif(F.sum("total"), F.lit(0.0))).alias("top_share"))
    return whole.join(F.broadcast(top))  # one row each
