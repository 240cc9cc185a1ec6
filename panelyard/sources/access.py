"""Reading what is stored: ranges, pages, searches, dates, names, and long observations as panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.sources.ingest import AVAILABLE, CLOSE


def in_time_range(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "datetime") -> DataFrame:
    """Rows from start to end; an end that is a date alone takes in that day."""
    if start:
        df = df.where(F.col(ts) >= F.to_timestamp(F.lit(start)))
    if end and len(end) == 10:
        return df.where(F.col(ts) < F.to_timestamp(F.lit(end)) + F.expr("INTERVAL 1 DAY"))
    return df.where(F.col(ts) <= F.to_timestamp(F.lit(end))) if end else df


def known_within(df: DataFrame, start: str, end: str, metric: str, date: str = "date") -> DataFrame:
    """Rows whose metric became known between two times, as bounds on the date alone, so that a scan can prune by it. An
    end that is a date alone takes in that day."""
    time = AVAILABLE.get(metric, CLOSE)
    first = f"date_add(to_date('{start}'), {int(start[11:] > time)})"
    last = f"date_sub(to_date('{end}'), {int((end[11:] or "24") < time)})"
    return df.where((F.col(date) >= F.expr(first)) & (F.col(date) <= F.expr(last)))


def selected(df: DataFrame, conditions: dict[str, object], columns: list[str]) -> DataFrame:
    """Columns of the rows that meet all conditions: a value, a list of values, or a pair of operator and value."""
    for name, wanted in conditions.items():
        c = F.col(name)
        if isinstance(wanted, tuple):
            op, value = wanted
            df = df.where({">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value, "!=": c != value}[op])
        else:
            df = df.where(c.isin(wanted) if isinstance(wanted, list) else c == wanted)
    return df.select(*columns)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of the different values of some columns, as text."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(parts.alias("p")).select("p.*").where("value is not null").distinct()


def searched(df: DataFrame, text: str) -> DataFrame:
    """Rows with the text in any column."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns))), F.lit(text.lower())))


def numbered_page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page of the rows, and with each row how many there are in all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))


def aligned(values: DataFrame, dates: DataFrame, x: str, code: str = "code", date: str = "date") -> DataFrame:
    """x of each code on each wanted date: its own, or the last before."""
    wanted = values.select(code).distinct().join(F.broadcast(dates.agg(F.collect_list(date).alias("__d")))).select(code, F.explode("__d").alias(date), F.lit(True).alias("__wanted"))
    both = values.select(code, date, x).join(wanted, [code, date], "full")
    filled = F.last(x, ignorenulls=True).over(Window.partitionBy(code).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(x, filled).where("__wanted").select(code, date, x)


def canonical_days(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """(keys, day, value): the last value of each key on a day, all under the day's latest time."""
    day = F.to_date(ts).alias("day")
    last = df.groupBy(*keys, day).agg(F.max_by(value, F.struct(ts, value)).alias(value))
    latest = df.groupBy(day).agg(F.max(ts).alias(ts))
    return last.join(latest, "day")


def panel_of(df: DataFrame, value: str, code: str = "code", date: str = "date") -> DataFrame:
    """One value a code and date: the mean of those there are."""
    return df.where(F.col(value).isNotNull()).groupBy(code, date).agg(F.avg(value).alias(value))


def named(df: DataFrame, names: DataFrame, code: str = "code") -> DataFrame:
    """Rows with the display name of their code, or the code where it has none. names: code, name."""
    return df.join(names, code, "left").withColumn("name", F.coalesce("name", F.col(code).cast("string")))


def probes(codes: DataFrame, times: DataFrame, code: str = "code", ts: str = "input_ts") -> DataFrame:
    """(code, ts, ordinal): every code at every time; ordinal counts a code's times. times is a calendar, not data."""
    listed = times.agg(F.sort_array(F.collect_list(ts)).alias("__t"))
    return codes.select(code).distinct().join(F.broadcast(listed)).select(code, F.posexplode("__t").alias("ordinal", ts))


def missing_keys(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")


def day_before(calendar: DataFrame, rebalances: DataFrame, date: str = "date") -> DataFrame:
    """(rebalance, signal): each rebalance date with the trading date before it."""
    w = Window.orderBy(date)  # a calendar has one row a day
    return calendar.select(date).distinct().withColumn("signal", F.lag(date).over(w)).join(rebalances.select(date), date, "left_semi").select(F.col(date).alias("rebalance"), "signal")


def outer_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' values at every key that either has."""
    return a.join(b, keys, "full")
