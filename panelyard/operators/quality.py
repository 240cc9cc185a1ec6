"""Checks and repairs of observation tables: counts of trouble, duplicates, fills, conflicts, rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, share): NULL, NaN and empty strings of each column, in one pass."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float")}
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if c in numeric else F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(False)))
    one = df.agg(F.count("*").alias("__n"), *(F.count_if(bad(c)).alias(c) for c in columns))
    return one.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.*", F.try_divide("x.missing", "__n").alias("share"))


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value, and how many; keys of equal repeats are fine."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(value).alias("values")).where("values > 1")


def keep_one(df: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """The last (or first) row of each key by `order`; rows of equal order go by their other columns, so that the choice
    doesn't depend on where they lie."""
    others = [F.asc(c) for c, t in df.dtypes if c not in keys and c != order and not t.startswith("map")]
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order), *others)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def strict_distinct(df: DataFrame, keys: list[str], verified: list[str]) -> DataFrame:
    """Removes repeats of a key only where all verified columns agree; keys that disagree keep all rows."""
    same = F.count_distinct(F.struct(*verified))
    judged = df.groupBy(*keys).agg(same.alias("__k"))
    joined = df.join(judged, keys)
    w = Window.partitionBy(*keys).orderBy(*verified)
    return joined.withColumn("__n", F.row_number().over(w)).where("__k > 1 or __n = 1").drop("__k", "__n")


def fill(df: DataFrame, x: str, how: str, code: str = "code", date: str = "date", value: float = 0.0) -> DataFrame:
    """drop, ffill, bfill, value, mean, median, mode or interpolate (linear in rows, inside the known values), by code."""
    w, all_ = Window.partitionBy(code).orderBy(date), Window.partitionBy(code)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    match how:
        case "drop":
            return df.where(F.col(x).isNotNull())
        case "ffill":
            out = F.last(x, ignorenulls=True).over(past)
        case "bfill":
            out = F.first(x, ignorenulls=True).over(future)
        case "value":
            out = F.lit(value)
        case "mean":
            out = F.avg(x).over(all_)
        case "median":
            out = F.percentile(x, F.lit(0.5)).over(all_)
        case "mode":
            best = df.where(F.col(x).isNotNull()).groupBy(code, F.col(x).alias("__v")).agg(F.count("*").alias("__c")).groupBy(code).agg(F.max_by("__v", F.struct("__c", -F.col("__v"))).alias("__m"))
            return df.join(best, code, "left").withColumn(x, F.coalesce(x, "__m")).drop("__m")
        case "interpolate":
            df = df.withColumn("__i", F.row_number().over(w))
            known = F.when(F.col(x).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(x).alias("v")))
            df = df.withColumn("__a", F.last(known, ignorenulls=True).over(past)).withColumn("__z", F.first(known, ignorenulls=True).over(future))
            share = (F.col("__i") - F.col("__a.i")) / (F.col("__z.i") - F.col("__a.i"))
            out = F.col("__a.v") + share * (F.col("__z.v") - F.col("__a.v"))
            return df.withColumn(x, F.coalesce(F.col(x), out)).drop("__i", "__a", "__z")
        case _:
            raise ValueError(how)
    return df.withColumn(x, F.coalesce(F.col(x), out))


def coverage(df: DataFrame, dataset: str, date: str = "date") -> DataFrame:
    return df.groupBy(dataset).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("rows"), F.count_distinct("code").alias("codes"))


def dataset_coverage(df: DataFrame, by: list[str], days: int, ts: str = "datetime", code: str = "code") -> DataFrame:
    """Rows, codes and range of each dataset; stale: it ends more than some days before the last of all."""
    latest = df.agg(F.max(ts).alias("__l"))
    found = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(code).alias("codes"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return found.join(F.broadcast(latest)).withColumn("stale", F.col("last") < F.col("__l") - F.expr(f"INTERVAL {days} DAYS")).drop("__l")


def time_report(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row about a text column of times: rows, what is no time, keys that come twice, first and last."""
    t = F.try_to_timestamp(F.trim(text))
    twice = df.withColumn("__t", t).where("__t is not null").groupBy(*keys, "__t").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated"))
    return df.agg(F.count("*").alias("rows"), F.count_if(t.isNull()).alias("not_a_time"), F.min(t).alias("first"), F.max(t).alias("last")).join(F.broadcast(twice))


def gaps(df: DataFrame, date: str = "date", code: str = "code") -> DataFrame:
    """(code, n, most_common_gap): days between a code's dates; the smaller of equally common gaps."""
    step = F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(code).orderBy(date)))
    counted = df.select(code, date).distinct().withColumn("gap", step).where("gap is not null").groupBy(code, "gap").agg(F.count("*").alias("k"))
    return counted.groupBy(code).agg(F.sum("k").alias("n"), F.max_by("gap", F.struct("k", -F.col("gap"))).alias("most_common_gap"))


def fixed_times(df: DataFrame, text: str, keys: list[str], order: str) -> DataFrame:
    """Rows whose text is a time, under that time; of rows with equal keys and time the last by `order`."""
    good = df.withColumn(text, F.try_to_timestamp(F.trim(text))).where(F.col(text).isNotNull())
    return keep_one(good, [*keys, text], order)


def inconsistent(df: DataFrame, keys: list[str], verified: list[str]) -> DataFrame:
    """(keys, rows, versions) of keys whose rows don't agree on the verified columns."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*verified)).alias("versions")).where("versions > 1")


def validated(df: DataFrame, keys: list[str], time: str, nulls: dict[str, str] | None = None, code: str = "code", sort: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fixed, report): the table with times read, repeats removed and gaps filled, and what was found before.

    Rows whose `time` is none are dropped, of rows with equal keys and time the first by their other columns stays; then each
    column of `nulls` is filled by code as it says (see fill; `raise`: a missing value is an error). report: check, column,
    rows."""
    found = [df.select(F.lit("missing").alias("check"), F.lit(c).alias("column"), F.col(c).isNull().alias("hit")) for c in nulls or {}]
    read = F.try_to_timestamp(F.trim(F.col(time).cast("string")))
    found.append(df.select(F.lit("not a time").alias("check"), F.lit(time).alias("column"), read.isNull().alias("hit")))
    report = found[0]
    for part in found[1:]:
        report = report.unionByName(part)
    again = df.withColumn("__t", read).where("__t IS NOT NULL").groupBy(*keys, "__t").agg(F.count("*").alias("k")).select(F.lit("repeated").alias("check"), F.lit(time).alias("column"), (F.col("k") - 1).alias("n"))
    report = report.groupBy("check", "column").agg(F.count_if("hit").alias("rows")).unionByName(again.groupBy("check", "column").agg(F.sum("n").alias("rows")))
    fixed = keep_one(df.withColumn(time, read).where(F.col(time).isNotNull()).withColumn("__one", F.lit(1)), [*keys, time], "__one", last=False).drop("__one")
    for column, how in (nulls or {}).items():
        if how == "raise":
            if (missing := fixed.where(F.col(column).isNull()).count()):
                raise ValueError(f"{column} is missing in {missing} rows")
        else:
            fixed = fill(fixed, column, how, code, time)
    return (fixed.orderBy(*keys, time) if sort else fixed), report


def first_complete(df: DataFrame, inputs: list[str], code: str = "code", date: str = "date") -> DataFrame:
    """(code, first): from when on a code has had each input at least once; NULL if one never came. The latest of them is
    when a run over all codes can begin."""
    starts = df.groupBy(code).agg(*[F.min(F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in inputs])
    both = F.greatest(*map(F.col, inputs)) if len(inputs) > 1 else F.col(inputs[0])
    complete = F.lit(True)
    for c in inputs:
        complete = complete & F.col(c).isNotNull()
    return starts.select(code, F.when(complete, both).alias("first"))
