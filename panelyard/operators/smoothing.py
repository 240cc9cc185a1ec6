"""Exponential means and what is built on them, as scans: no recursion, no Python, whatever the length of a history.

An exponential mean is y = a * y_before + (1 - a) * x at each observation. Written out, y is a sum of past values decayed
by products of a, that is by differences of a running sum of logarithms. Sums of decayed values overflow over a long
history, so they are kept by blocks in which the decay stays below e^12 (five of sixteen digits); a block takes over from
the blocks before it what is left of them, and eight blocks back nothing is left that a double could hold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decay within a block, as a logarithm, and how many blocks back are taken over (each two of them decay by this much).
SPAN, BACK = 12.0, 8


def exponential_mean(df: DataFrame, x: str, alpha: float, name: str, code: str = "code", date: str = "date") -> DataFrame:
    """Adds the exponential mean of x by code: the first value seeds it, each later one counts alpha, and what stands
    before it counts (1 - alpha) to the number of bars since; both are scaled to 1. Bars without x keep the mean."""
    if not 0 < alpha < 1:
        raise ValueError(f"alpha {alpha} is not between 0 and 1")
    order = Window.partitionBy(code).orderBy(date)
    before, up_to = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col(x).isNotNull()
    rows = df.withColumn("__k", F.row_number().over(order)).withColumn("__prev", F.last(F.when(seen, F.col("__k")), True).over(before))
    kept = F.exp(F.greatest((F.col("__k") - F.col("__prev")) * math.log1p(-alpha), F.lit(-600.0)))
    rows = rows.withColumn("__a", F.when(seen & F.col("__prev").isNotNull(), F.ln(kept / (kept + alpha))).otherwise(0.0))
    rows = rows.withColumn("__w", F.when(seen, F.when(F.col("__prev").isNull(), F.col(x)).otherwise(F.col(x) * alpha / (kept + alpha))))
    rows = rows.withColumn("__sum", F.sum("__a").over(up_to)).withColumn("__block", F.floor(-F.col("__sum") / SPAN))
    inside = Window.partitionBy(code, "__block").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__top", F.max("__sum").over(Window.partitionBy(code, "__block")))
    rows = rows.withColumn("__own", F.exp(F.col("__sum") - F.col("__top")) * F.sum(F.col("__w") * F.exp(F.col("__top") - F.col("__sum"))).over(inside))
    # a block's last row is the one of its largest decay (rows without x repeat it)
    blocks = rows.groupBy(code, "__block").agg(F.min("__sum").alias("__end"), F.max_by("__own", F.col("__k")).alias("__left"))
    by_block = Window.partitionBy(code).orderBy("__block")
    handed = F.lit(0.0)
    for k in range(1, BACK + 1):
        # what the k-th block before left, decayed to the end of the block just before this one
        handed = handed + F.coalesce(F.lag("__left", k).over(by_block) * F.exp(F.lag("__end", 1).over(by_block) - F.lag("__end", k).over(by_block)), F.lit(0.0))
    taken = blocks.select(code, "__block", F.lag("__end").over(by_block).alias("__from"), handed.alias("__handed"))
    joined = rows.join(taken, [code, "__block"])
    started = F.col("__k") >= F.min(F.when(seen, F.col("__k"))).over(Window.partitionBy(code))
    carried = F.coalesce(F.col("__handed") * F.exp(F.col("__sum") - F.col("__from")), F.lit(0.0))
    return joined.withColumn(name, F.when(started, F.coalesce("__own", F.lit(0.0)) + carried)).select(*df.columns, name)


def moving_mean(df: DataFrame, x: str, n: int, name: str, m: int = 1, code: str = "code", date: str = "date") -> DataFrame:
    """The exponential mean in which a value counts m / n."""
    return exponential_mean(df, x, m / n, name, code, date)


def span_mean(df: DataFrame, x: str, n: int, name: str, code: str = "code", date: str = "date") -> DataFrame:
    """The exponential mean of a span of n: alpha is 2 / (n + 1)."""
    return exponential_mean(df, x, 2 / (n + 1), name, code, date)


def relative_strength(df: DataFrame, price: str, n: int, name: str = "rsi", code: str = "code", date: str = "date") -> DataFrame:
    """100 times the mean rise of the price over its mean change, both exponential with 1 / n."""
    step = F.col(price) - F.lag(price).over(Window.partitionBy(code).orderBy(date))
    rows = df.withColumn("__d", step).withColumns({"__rise": F.greatest("__d", F.lit(0.0)), "__move": F.abs("__d")})
    rows = rows.withColumn("__rise", F.when(F.col("__d").isNotNull(), F.col("__rise")))
    both = moving_mean(moving_mean(rows, "__rise", n, "__up", 1, code, date), "__move", n, "__all", 1, code, date)
    return both.withColumn(name, F.try_divide(F.col("__up"), F.nullif(F.col("__all"), F.lit(0.0))) * 100).select(*df.columns, name)
