"""Upkeep of stored history: observations of a value over time come late, twice and in any order of loads.

What is stored is the observations themselves, one a key and time; intervals follow from them. A load touches the keys it
names: only those are read again, and their intervals written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.asof import intervals_of


def merged(points: DataFrame, staged: DataFrame, key: str = "code", ts: str = "datetime", value: str = "value", load: str = "load") -> DataFrame:
    """The stored observations after a load: (key, ts, value, load). Of one key and time the latest load's value stays (of
    one load the larger), and a NULL never replaces a value; so loads may come in any order, and twice."""
    both = points.select(key, ts, value, load).unionByName(staged.select(key, ts, value, load)).where(F.col(value).isNotNull() & F.col(key).isNotNull() & F.col(ts).isNotNull())
    best = both.groupBy(key, ts).agg(F.max(F.struct(load, value)).alias("__b"))
    return best.select(key, ts, F.col(f"__b.{value}").alias(value), F.col(f"__b.{load}").alias(load))


def refreshed(intervals: DataFrame, points: DataFrame, staged: DataFrame, key: str = "code", ts: str = "datetime", value: str = "value") -> DataFrame:
    """The stored intervals (key, value, valid_from, valid_to) after a load that led to `points`: those of the load's keys
    anew, the others as they are."""
    touched = staged.select(key).distinct()
    return intervals.join(touched, key, "left_anti").unionByName(intervals_of(points.join(touched, key, "left_semi"), key, ts, value))


def facts_and_rest(staged: DataFrame, core: list[str], keys: list[str], metric: str = "metric", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(facts, observations) of long rows: the core metrics as columns, one row a key (the largest of repeated values), and
    the rows of all other metrics."""
    columns = [F.max(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in core]
    return staged.where(F.col(metric).isin(core)).groupBy(*keys).agg(*columns), staged.where(~F.col(metric).isin(core))


def changed_days(before: DataFrame, after: DataFrame, keys: list[str], day: str) -> DataFrame:
    """The days on which the two tables differ in any row."""
    values = [c for c in after.columns if c not in keys]
    old = before.select(*keys, F.struct(*values).alias("__old"), F.lit(1).alias("__o"))
    new = after.select(*keys, F.struct(*values).alias("__new"), F.lit(1).alias("__n"))
    same = F.col("__o").isNotNull() & F.col("__n").isNotNull() & F.col("__old").eqNullSafe(F.col("__new"))
    return old.join(new, keys, "full").where(~same).select(day).distinct()


def latest(points: DataFrame, key: str = "code", ts: str = "datetime", value: str = "value") -> DataFrame:
    """(key, value): the last observation of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(value)))
    return points.withColumn("__r", last).where("__r = 1").select(key, value)
