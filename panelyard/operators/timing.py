"""Signals of single series: thresholds, runs of active days and their tables, rule signals and their back-tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(code: str, date: str):
    return Window.partitionBy(code).orderBy(date)


def rolling_threshold(df: DataFrame, x: str, n: int, sigma: float, code: str = "code", date: str = "date") -> DataFrame:
    """threshold = mean + sigma * deviation of the n values before a row; weight 1 where x is above it, else 0; both NULL
    until there are n values. Rows without x are left out."""
    valid = df.where(F.col(x).isNotNull())
    w = _w(code, date).rowsBetween(-n, -1)
    edge = F.when(F.count(x).over(w) == n, F.avg(x).over(w) + sigma * F.stddev_samp(x).over(w))
    return valid.withColumn("threshold", edge).withColumn("weight", F.when(F.col("threshold").isNotNull(), (F.col(x) > F.col("threshold")).cast("double")))


def runs(df: DataFrame, active: Column, code: str = "code", date: str = "date", name: str = "run") -> DataFrame:
    """Numbers the runs of consecutive active rows of each code from 1; NULL outside of runs."""
    df = df.withColumn("__a", F.coalesce(active, F.lit(False)))
    start = F.col("__a") & ~F.coalesce(F.lag("__a").over(_w(code, date)), F.lit(False))
    number = F.sum(start.cast("int")).over(_w(code, date).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(F.col("__a"), number)).drop("__a")


def run_table(df: DataFrame, x: str, code: str = "code", date: str = "date", run: str = "run") -> DataFrame:
    """One row a run: dates, length, and what x did in it."""
    d = df.where(F.col(run).isNotNull()).withColumn("__d", F.col(x) - F.lag(x).over(Window.partitionBy(code, run).orderBy(date)))
    return d.groupBy(code, run).agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("length"), F.sum(x).alias("total"), F.min_by(x, date).alias("first"), F.max_by(x, date).alias("last"),
        F.max(x).alias("high"), F.min(x).alias("low"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.count_if(F.col("__d") > 0).alias("up"), F.count_if(F.col("__d") < 0).alias("down"),
    ).withColumn("change", F.col("last") - F.col("first"))


def rule_signals(df: DataFrame, x: str, n: int = 5, code: str = "code", date: str = "date") -> DataFrame:
    """(code, date, rule, signal in 1, 0, -1): mean with one deviation, moving average, extreme fifths, sign, change,
    and the change of the moving average. Means and quantiles are those of the whole series of a code."""
    all_ = Window.partitionBy(code)
    w = _w(code, date)
    ma = F.avg(x).over(w.rowsBetween(-(n - 1), 0))
    df = df.where(F.col(x).isNotNull()).withColumns({"__m": F.avg(x).over(all_), "__s": F.stddev_samp(x).over(all_), "__q": F.percentile(x, F.array(F.lit(0.2), F.lit(0.8))).over(all_), "__ma": ma, "__b": F.lag(x).over(w)})
    df = df.withColumn("__mb", F.lag("__ma").over(w))
    v = F.col(x)
    three = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
    rules = {
        "band": three(v > F.col("__m") + F.col("__s"), v < F.col("__m") - F.col("__s")), "average": three(v > F.col("__ma"), v < F.col("__ma")), "extreme": three(v >= F.col("__q")[1], v <= F.col("__q")[0]),
        "sign": three(v > 0, v < 0), "change": three(v > F.col("__b"), v < F.col("__b")), "average_change": three(F.col("__ma") > F.col("__mb"), F.col("__ma") < F.col("__mb")),
    }
    return df.select(code, date, F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("signal")) for k, c in rules.items()])).alias("r")).select(code, date, "r.rule", "r.signal")


def signal_backtest(df: DataFrame, signal: str, ret: str, keys: tuple[str, ...] = ("code",), date: str = "date") -> DataFrame:
    """Per key: total return of yesterday's signal held today, days in the market, hit rate, and number of position changes."""
    w = Window.partitionBy(*keys).orderBy(date)
    df = df.withColumn("__p", F.coalesce(F.lag(signal).over(w), F.lit(0))).withColumn("__r", F.col("__p") * F.coalesce(F.col(ret), F.lit(0.0)))
    df = df.withColumn("__c", (F.col("__p") != F.coalesce(F.lag("__p").over(w), F.lit(0))).cast("int"))
    return df.groupBy(*keys).agg((F.exp(F.sum(F.log1p(F.greatest("__r", F.lit(-0.999999))))) - 1).alias("total"), F.count_if(F.col("__p") != 0).alias("days_in"), F.try_divide(F.count_if(F.col("__r") > 0), F.count_if(F.col("__p") != 0)).alias("hit_rate"), F.sum("__c").alias("changes"))


def array_quantile(values: Column, q: float) -> Column:
    """The linear quantile of an array's numbers; NULL of an empty one."""
    ordered = F.sort_array(values)
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.get(ordered, F.floor(at).cast("int")).cast("double")
    high = F.get(ordered, F.least(F.floor(at) + 1, F.size(ordered) - F.lit(1)).cast("int"))
    return F.when(F.size(ordered) > 0, low + (high - low) * (at - F.floor(at)))


def resolved_events(df: DataFrame, x: str, high: str, active: Column, code: str = "code", date: str = "date") -> tuple[DataFrame, DataFrame]:
    """The rows with their place and run, and a row for each run: first and last place, length, sum of x, and when a later
    row's `high` first passed the run's highest (resolved_at) and how many rows after its end that was (wait).

    A code's rows are one array for the search of later highs: as many numbers as it has bars."""
    rows = runs(df.withColumn("__place", F.row_number().over(_w(code, date))), active, code, date)
    own = rows.where("run IS NOT NULL").groupBy(code, "run").agg(F.min("__place").alias("start"), F.max("__place").alias("end"), F.count("*").alias("length"), F.sum(x).alias("total"), F.max(high).alias("level"))
    highs = rows.groupBy(code).agg(F.transform(F.sort_array(F.collect_list(F.struct("__place", F.col(high).cast("double").alias("h")))), lambda r: r["h"]).alias("highs"))
    each = own.groupBy(code).agg(F.collect_list(F.struct("run", "start", "end", "length", "total", "level")).alias("events")).join(highs, code)
    later = F.transform("events", lambda e: F.struct(e.alias("e"), F.array_position(F.transform(F.slice("highs", e["end"] + 1, F.size("highs")), lambda h: F.coalesce(h > e["level"], F.lit(False))), True).alias("wait")))
    found = each.select(code, F.explode(later).alias("l")).select(code, "l.e.*", F.when(F.col("l.wait") > 0, F.col("l.wait")).alias("wait"))
    return rows, found.withColumn("resolved_at", F.col("end") + F.col("wait"))


def event_history_weights(
    df: DataFrame, x: str, high: str, threshold: float, history: int = 10, duration: float = 0.65, exit_wait: float = 0.75, least: int = 3, default_wait: int = 5, most: float = 1.0, code: str = "code", date: str = "date"
) -> DataFrame:
    """(code, date, weight) of every row: what runs above the threshold have earned by what earlier runs were like.

    A run opens on the day that a quantile of the last runs' lengths says, with the sum of x so far over the mean sum of
    those runs (`most` at most), and holds its last weight after its end for a quantile of the waits of the last runs whose
    new high was known before this one began. Fewer than `least` earlier runs: no weight. Where runs overlap, the larger."""
    rows, events = resolved_events(df, x, high, F.col(x) > threshold, code, date)
    by = Window.partitionBy(code).orderBy("end")
    before, last = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(-history, -1)
    known = F.filter(F.collect_list(F.struct("end", "resolved_at", "wait")).over(before), lambda e: e["resolved_at"].isNotNull() & (e["resolved_at"] < F.col("start")))
    waits = F.transform(F.slice(F.reverse(F.sort_array(known)), 1, history), lambda e: e["wait"])
    day = lambda q: F.ceil(F.round(q, 9)).cast("int")
    judged = events.withColumns({"__n": F.count("*").over(last), "__mean": F.avg("total").over(last), "__open": day(array_quantile(F.collect_list("length").over(last), duration)), "__waits": waits})
    judged = judged.where((F.col("__n") >= least) & (F.abs("__mean") > 1e-12)).select(code, "run", "end", "__mean", F.greatest("__open", F.lit(1)).alias("__open"), F.coalesce(F.greatest(day(array_quantile("__waits", exit_wait)), F.lit(0)), F.lit(default_wait)).alias("__hold"))
    inside = Window.partitionBy(code, "run").orderBy("__place")
    active = rows.where("run IS NOT NULL").withColumn("__day", F.row_number().over(inside)).withColumn("__so_far", F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    earned = active.join(judged, [code, "run"]).where(F.col("__day") >= F.col("__open")).withColumn("weight", F.least(F.lit(most), F.greatest(F.lit(0.0), F.col("__so_far") / F.col("__mean"))))
    held = earned.where((F.col("__place") == F.col("end")) & (F.col("weight") > 0) & (F.col("__hold") > 0)).select(code, F.explode(F.sequence(F.col("end") + 1, F.col("end") + F.col("__hold"))).alias("__place"), "weight")
    best = earned.select(code, "__place", "weight").unionByName(held).groupBy(code, "__place").agg(F.max("weight").alias("weight"))
    return rows.select(code, date, "__place").join(best, [code, "__place"], "left").select(code, date, F.coalesce("weight", F.lit(0.0)).alias("weight"))
