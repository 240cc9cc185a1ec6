"""Point-in-time joins: as-of before and after, within a range, temporal validity, universes and status.

All as-of joins share one plan: facts and probes are united, and one ordered pass over each code carries the nearest
fact to each probe. That is one shuffle by code, and no row ever multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000  # microseconds


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    micros = lambda c: F.unix_micros(F.to_timestamp(c))
    return (micros(later) - micros(earlier)) / HOUR


def nearest(probes: DataFrame, facts: DataFrame, direction: str = "before", tolerance_hours: float | None = None, code: str = "code", probe_ts: str = "input_ts", fact_ts: str = "datetime") -> DataFrame:
    """Each probe with the nearest fact of its code: the latest at or before it, or the earliest strictly after it.

    Probes without a fact in reach keep NULLs; diff_hours is the distance. facts may have any further columns."""
    values = [c for c in facts.columns if c not in (code, fact_ts)]
    fact = F.struct(F.col(fact_ts).alias(fact_ts), *values)
    extra = [c for c in probes.columns if c not in (code, probe_ts)]
    left = probes.select(code, F.col(probe_ts).alias("__ts"), F.lit(1).alias("__probe"), F.struct(F.col(probe_ts), *extra).alias("__p")).withColumn("__f", F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType))
    right = facts.select(code, F.col(fact_ts).alias("__ts"), F.lit(0).alias("__probe"), F.lit(None).cast(left.schema["__p"].dataType).alias("__p"), fact.alias("__f"))
    by_code = Window.partitionBy(code)
    # at equal times a fact comes before the probe for "before", and after it (so it is passed over) for "after"
    order = by_code.orderBy("__ts", "__probe") if direction == "before" else by_code.orderBy(F.desc("__ts"), F.desc("__probe"))
    hit = F.last("__f", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = left.unionByName(right).withColumn("__hit", hit).where("__probe = 1")
    gap = hours_between(F.col("__ts"), F.col(f"__hit.{fact_ts}"))
    gap = gap if direction == "before" else -gap
    near = F.col("__hit").isNotNull() if tolerance_hours is None else gap <= tolerance_hours
    kept = F.when(near, F.col("__hit"))
    return found.withColumn("__hit", kept).select(
        F.col(code), F.col("__p")[probe_ts].alias(probe_ts), *(F.col("__p")[c].alias(c) for c in extra),
        F.col("__hit")[fact_ts].alias(fact_ts), *(F.col("__hit")[c].alias(c) for c in values), F.when(near, gap).alias("diff_hours"),
    )


def nearest_in_range(probes: DataFrame, facts: DataFrame, direction: str, code: str = "code", start: str = "start_ts", end: str = "end_ts", fact_ts: str = "datetime") -> DataFrame:
    """after: the first fact with start < t < end; before: the last with start <= t <= end. The nearest fact is the only
    one that can qualify, so the range is a filter on it."""
    anchor = start if direction == "after" else end
    hit = nearest(probes.withColumn("__anchor", F.col(anchor)), facts, direction, None, code, "__anchor", fact_ts).drop("__anchor", "diff_hours")
    inside = (F.col(fact_ts) > F.col(start)) & (F.col(fact_ts) < F.col(end)) if direction == "after" else (F.col(fact_ts) >= F.col(start)) & (F.col(fact_ts) <= F.col(end))
    values = [c for c in facts.columns if c != code]
    return hit.withColumns({c: F.when(inside, F.col(c)) for c in values if c != fact_ts} | {fact_ts: F.when(inside, F.col(fact_ts))})


def valid_at(probes: DataFrame, intervals: DataFrame, key: str = "code", ts: str = "input_ts") -> DataFrame:
    """The interval of each probe's key with valid_from <= ts and (valid_to open or > ts); NULLs where there is none."""
    hit = nearest(probes, intervals.withColumnRenamed("valid_from", "datetime"), "before", None, key, ts).drop("diff_hours").withColumnRenamed("datetime", "valid_from")
    holds = F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(ts)))
    values = [c for c in intervals.columns if c != key]
    return hit.withColumns({c: F.when(holds, F.col(c)) for c in values})


def intervals_of(history: DataFrame, key: str = "code", ts: str = "datetime", value: str = "value") -> DataFrame:
    """(key, value, valid_from, valid_to): one interval per change of the value; the last stays open."""
    w = Window.partitionBy(key).orderBy(ts)
    changed = history.withColumn("__before", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1).where(F.col("__first") | ~F.col("__before").eqNullSafe(F.col(value)))
    return changed.select(key, value, F.col(ts).alias("valid_from"), F.lead(ts).over(w).alias("valid_to"))


def labels_at(probes: DataFrame, membership: DataFrame, scheme: str, exact: bool = False, ts: str = "input_ts") -> DataFrame:
    """(code, ts, value): the label of each probe's code under a scheme, or under the latest of all versions of it (those
    whose names begin so). A code's memberships under one scheme follow each other without gaps."""
    some = membership.where((F.col("scheme") == scheme) if exact else F.startswith("scheme", F.lit(scheme)))
    last = some.groupBy("code", "valid_from").agg(F.max_by("value", "scheme").alias("value"))
    return nearest(probes, last.withColumnRenamed("valid_from", "datetime"), "before", None, "code", ts).select("code", ts, "value")


def members_at(membership: DataFrame, ts: str, labels: list[str]) -> DataFrame:
    """(code, value) of the codes whose latest label at a time is among the wanted ones."""
    latest = membership.where(F.col("valid_from") <= F.to_timestamp(F.lit(ts))).groupBy("code").agg(F.max_by("value", F.struct("valid_from", "scheme")).alias("value"))
    return latest.where(F.col("value").isin(labels))


def universe_at(dates: DataFrame, snapshots: DataFrame, date: str = "date") -> DataFrame:
    """(date, code, ordinal): the constituents of the latest snapshot at or before each date. snapshots: effective_at,
    code, ordinal. Snapshot dates are few; constituents join by equality."""
    effective = snapshots.select(F.lit(1).alias("k"), F.col("effective_at").alias("datetime")).distinct()
    probes = dates.select(F.lit(1).alias("k"), F.col(date).alias("input_ts")).distinct()
    at = nearest(probes, effective, "before", None, "k").select(F.col("input_ts").alias(date), F.col("datetime").alias("effective_at"))
    return at.join(snapshots, "effective_at").select(date, "code", "ordinal")


def in_universe(panel: DataFrame, universe: DataFrame, date: str = "date") -> DataFrame:
    return panel.join(universe.select(date, "code"), [date, "code"], "left_semi")


def mask_outside(panel: DataFrame, universe: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """All rows stay; the columns are NULL where the code is no member on the date."""
    member = universe.select(date, "code", F.lit(True).alias("__in")).distinct()
    return panel.join(member, [date, "code"], "left").withColumns({c: F.when(F.col("__in"), F.col(c)) for c in columns}).drop("__in")


def trade_status(panel: DataFrame, listing: DataFrame, events: DataFrame, date: str = "date") -> DataFrame:
    """(date, code, status): -1 before the first and after the last trade date, an event's status, else 1.

    listing: code, first_date, last_date (NULL: still listed); events: code, date, status."""
    joined = panel.select(date, "code").join(listing, "code", "left").join(events.select("code", date, F.col("status").alias("__event")), ["code", date], "left")
    out = F.col("first_date").isNull() | (F.col(date) < F.col("first_date")) | (F.col("last_date").isNotNull() & (F.col(date) > F.col("last_date")))
    return joined.select(date, "code", F.when(out, -1).otherwise(F.coalesce("__event", F.lit(1))).alias("status"))


def period_ends(calendar: DataFrame, period: str, date: str = "date") -> DataFrame:
    """The last trading date of each day, week, month, quarter, half-year or year (D W M Q S Y)."""
    d = F.col(date)
    key = {"D": d, "W": F.date_trunc("week", d), "M": F.date_trunc("month", d), "Q": F.date_trunc("quarter", d), "Y": F.date_trunc("year", d), "S": F.concat_ws("-", F.year(d).cast("string"), F.ceil(F.month(d) / 6).cast("string"))}[period]
    return calendar.select(date).distinct().groupBy(key.alias("period")).agg(F.max(date).alias(date)).select(date)


def shifted(dates: DataFrame, calendar: DataFrame, offset: int, date: str = "date") -> DataFrame:
    """(date, shifted): the trading date `offset` places after (or before) each date; NULL beyond the calendar."""
    place = F.row_number().over(Window.orderBy(date))  # a calendar has one row a day
    numbered = calendar.select(date).distinct().withColumn("n", place)
    target = numbered.select(F.col(date).alias("shifted"), (F.col("n") - offset).alias("n"))
    return dates.join(numbered, date).join(target, "n", "left").select(date, "shifted")


def at_or_after(probes: DataFrame, facts: DataFrame, probe_date: str, fact_date: str, code: str = "code") -> DataFrame:
    """Each probe (dates) with the earliest fact of its code at or after it."""
    fine = lambda c: F.to_timestamp(c) - F.expr("INTERVAL 1 SECOND")
    hit = nearest(probes.withColumn("__at", fine(probe_date)), facts.withColumn("__fact", F.to_timestamp(fact_date)), "after", None, code, "__at", "__fact")
    return hit.drop("__at", "__fact", "diff_hours")


def execution_prices(rebalances: DataFrame, prices: DataFrame, hours: float, code: str = "code") -> DataFrame:
    """The first price after each rebalance and before the code's next one; after the last, within some hours."""
    later = F.lead("start_ts").over(Window.partitionBy(code).orderBy("start_ts"))
    ends = rebalances.withColumn("end_ts", F.coalesce(later, F.col("start_ts") + F.expr(f"INTERVAL {hours} HOURS")))
    return nearest_in_range(ends, prices, "after", code)
