"""Event studies: bars around events, day statistics, cumulative returns. Long rows (code, event, day, ret)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_returns(events: DataFrame, prices: DataFrame, before: int, after: int, cutoff_hour: int = 15) -> DataFrame:
    """(code, event_id, day, ret) for days -before..after around each event.

    Day 0 is the first bar at or after the event's date, or after the date where the event came at or after the cutoff
    hour. events: code, event_id, event_ts; prices: code, date, price (one row a bar)."""
    w = Window.partitionBy("code").orderBy("date")
    bars = prices.withColumn("bar", F.row_number().over(w)).withColumn("ret", F.try_divide("price", F.lag("price").over(w)) - 1)
    due = events.withColumn("due", F.date_add(F.to_date("event_ts"), (F.hour("event_ts") >= cutoff_hour).cast("int")))
    # many events share a due date: its first bar is found once, in one ordered pass over bars and dates of a code
    dates = due.select("code", "due").distinct()
    both = bars.select("code", F.col("date").alias("at"), F.lit(0).alias("e"), "bar").unionByName(dates.select("code", F.col("due").alias("at"), F.lit(1).alias("e"), F.lit(None).cast("int").alias("bar")))
    zero = F.last("bar", ignorenulls=True).over(Window.partitionBy("code").orderBy(F.desc("at"), "e").rowsBetween(Window.unboundedPreceding, 0))
    first = both.withColumn("zero", zero).where("e = 1 and zero is not null").select("code", F.col("at").alias("due"), "zero")
    placed = due.join(first, ["code", "due"]).select("code", F.col("event_id").cast("string").alias("event_id"), "zero")
    days = placed.select("code", "event_id", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("day"), "zero").withColumn("bar", F.col("zero") + F.col("day"))
    return days.join(bars.select("code", "bar", "ret"), ["code", "bar"]).select("code", "event_id", "day", "ret")


def day_statistics(rows: DataFrame, day: str = "day") -> DataFrame:
    """Per day over events: count, mean, deviation, share of gains, odds and t value."""
    m, s, n = F.avg("ret"), F.stddev_samp("ret"), F.count("ret")
    up, down = F.count_if(F.col("ret") > 0), F.count_if(F.col("ret") < 0)
    return rows.groupBy(day).agg(n.alias("n"), m.alias("mean"), s.alias("std"), F.try_divide(up, n).alias("p_up"), F.try_divide(up, down).alias("odds"), (F.try_divide(m, F.nullif(s, F.lit(0.0))) * F.sqrt(n)).alias("t"))


def cumulative(rows: DataFrame, start: int = 0) -> DataFrame:
    """Adds the return compounded outward from day `start`, which both directions include; NULL returns count as none."""
    g = F.log1p(F.coalesce(F.col("ret"), F.lit(0.0)))
    forward = Window.partitionBy("code", "event_id").orderBy("day").rangeBetween(start - 10**9, 0)
    ahead = F.sum(F.when(F.col("day") >= start, g)).over(forward)
    behind = F.sum(F.when(F.col("day") <= start, g)).over(Window.partitionBy("code", "event_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cumulative", F.exp(F.when(F.col("day") >= start, ahead).otherwise(behind)) - 1)


def adjusted(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns less the benchmark's on the same event and day; only days that both have."""
    other = benchmark.groupBy("event_id", "day").agg(F.avg("ret").alias("__b"))
    return rows.join(other, ["event_id", "day"]).withColumn("ret", F.col("ret") - F.col("__b")).drop("__b")


def by_event(rows: DataFrame) -> DataFrame:
    """(event_id, day, ret): the mean over codes, where an event concerns several."""
    return rows.groupBy("event_id", "day").agg(F.avg("ret").alias("ret"), F.count("ret").alias("codes"))


def at_offsets(rows: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """(code, event_id, period, cumulative) at fixed offsets from day 0. offsets: period -> day."""
    label = F.element_at(F.create_map(*[F.lit(x) for k, d in offsets.items() for x in (d, k)]), F.col("day"))
    return cumulative(rows).where(F.col("day").isin(list(offsets.values()))).select("code", "event_id", label.alias("period"), "cumulative")


def period_statistics(rows: DataFrame, x: str = "cumulative", by: str = "period") -> DataFrame:
    return day_statistics(rows.withColumn("ret", F.col(x)), by)


def event_coverage(events: DataFrame, rows: DataFrame) -> DataFrame:
    """(code, events, placed, days): how many of a code's events have bars around them."""
    placed = rows.groupBy("code").agg(F.count_distinct("event_id").alias("placed"), F.count("ret").alias("days"))
    return events.groupBy("code").agg(F.count_distinct("event_id").alias("events")).join(placed, "code", "left").select("code", "events", F.coalesce("placed", F.lit(0)).alias("placed"), F.coalesce("days", F.lit(0)).alias("days"))


def mean_curves(rows: DataFrame) -> DataFrame:
    """(code, day, n, cumulative): the mean over a code's events of the return compounded outward from day 0."""
    return cumulative(rows).groupBy("code", "day").agg(F.count("*").alias("n"), F.avg("cumulative").alias("cumulative"))
