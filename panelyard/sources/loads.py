"""Loads that find out for themselves what a table is: long rows, one column a metric, or headers that carry metadata."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.sources.ingest import number

LONG = {"datetime", "code", "name", "metric", "value"}
#: Column names (lower case) that make a table a daily one.
CODES, NAMES, DATES = ("code", "ticker", "symbol"), ("name", "short_name"), ("date", "trade_date", "datetime")


def shape(columns: list[str]) -> str:
    """long, daily (a code, a name and a date column beside metrics) or header (metrics with metadata in their names)."""
    have = {c.strip().lower() for c in columns}
    return "long" if LONG <= have else "daily" if have & set(CODES) and have & set(NAMES) and have & set(DATES) else "header"


def one_of(columns: list[str], names: tuple[str, ...], place: int | None = None) -> str | None:
    """The first of `names` among the columns, whatever their case; else the column at a place."""
    by_name = {c.strip().lower(): c for c in reversed(columns)}
    found = next((by_name[n] for n in names if n in by_name), None)
    return found if found or place is None or place >= len(columns) else columns[place]


def day_in(text: str | None) -> str | None:
    """The first eight digits of a text, if they are a date."""
    for digits in re.findall(r"\d{8}", text or "")[:1]:
        try:
            return dt.datetime.strptime(digits, "%Y%m%d").strftime("%Y-%m-%d")
        except ValueError:
            return None
    return None


def header(column: str) -> dict[str, str | None]:
    """What a header says: `metric [note] kind [unit note] unit`, each after the metric optional. The note's date, or else
    the first in the header, is the day."""
    notes = re.findall(r"\[([^\]]+)\]", column)
    words = re.sub(r"\[[^\]]+\]", " ", column).split()
    at = lambda x, k: x[k] if len(x) > k else None
    return {"header": column, "metric": at(words, 0) or column.strip(), "note": at(notes, 0), "kind": at(words, 1), "unit_note": at(notes, 1), "unit": at(words, 2), "day": day_in(at(notes, 0)) or day_in(column)}


def path_day(path: Column | str) -> Column:
    """The date in the last part of a file's path that has eight digits (for `_metadata.file_path`)."""
    return F.try_to_date(F.regexp_extract(path, r".*(\d{8})[^/]*(?:/[^/\d]*)?", 1), "yyyyMMdd") if isinstance(path, Column) else path_day(F.col(path))


def by_headers(df: DataFrame, file_day: Column | str | None = None, time: str = "15:00:01", footers: tuple[str, ...] = ()) -> DataFrame:
    """(datetime, code, name, metric, value, remark) of a table whose metric columns have metadata in their names.

    The time is that of the file's day (file_day, a column of the table, if it is given and not NULL) or of the header's.
    Rows without any cell, and rows in which a text contains one of `footers`, are no data. Cells that are no number leave
    NULL. Headers are read on the driver, one a column, and joined to the cells by their number."""
    own = [c for c in df.columns if c != file_day]
    code, name = one_of(own, CODES, 0), one_of(own, NAMES, 1)
    metrics = [c for c in own if c not in (code, name)]
    said = [header(c) for c in metrics]
    there = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in own)).isNotNull()
    rows = df.where(there)
    texts = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")), F.lit("")) for c in own]
    for word in footers:
        rows = rows.where(~F.greatest(*(F.contains(t, F.lit(word.lower())) for t in texts)))
    day = F.col(file_day) if isinstance(file_day, str) else file_day if file_day is not None else F.lit(None).cast("date")
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for i, c in enumerate(metrics)])
    long = rows.select(day.cast("date").alias("__day"), F.col(f"`{code}`").cast("string").alias("code"), F.col(f"`{name or code}`").cast("string").alias("name"), F.explode(cells).alias("c")).select("__day", "code", "name", "c.*")
    kept = ("header", "note", "kind", "unit_note", "unit")
    map_ = df.sparkSession.createDataFrame([(i, s["metric"], s["day"], *(s[k] for k in kept)) for i, s in enumerate(said)], "column int, metric string, day string, " + ", ".join(f"{k} string" for k in kept))
    told = F.map_filter(F.create_map(*[x for k in kept for x in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    when = F.to_timestamp(F.concat_ws(" ", F.coalesce(F.date_format("__day", "yyyy-MM-dd"), "day"), F.when(F.coalesce(F.col("__day").cast("string"), F.col("day")).isNotNull(), F.lit(time))))
    joined = long.join(F.broadcast(map_), "column")  # one row a column of the table
    return joined.select(F.when(F.coalesce(F.col("__day").cast("string"), F.col("day")).isNotNull(), when).alias("datetime"), "code", "name", "metric", number("cell").alias("value"), told.alias("remark"))


def any_shape(df: DataFrame, time: str = "15:00:01", **options) -> DataFrame:
    """(datetime, code, name, metric, value) of a table of any of the three shapes."""
    columns = ["datetime", "code", "name", "metric", "value"]
    kind = shape(df.columns)
    if kind == "long":
        named = {c: c.strip().lower() for c in df.columns if c.strip().lower() in LONG}
        return df.withColumnsRenamed(named).select(F.to_timestamp("datetime").alias("datetime"), "code", "name", "metric", F.col("value").cast("double").alias("value"))
    if kind == "header":
        return by_headers(df, time=time, **options).select(*columns)
    code, name, date = (one_of(df.columns, names) for names in (CODES, NAMES, DATES))
    values = [c for c in df.columns if c not in (code, name, date)]
    long = df.select(F.to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), F.lit(time))).alias("datetime"), F.col(code).cast("string").alias("code"), F.col(name).cast("string").alias("name"), *(F.col(c).cast("double").alias(c) for c in values))
    return long.unpivot(["datetime", "code", "name"], values, "metric", "value").where("value IS NOT NULL")


def judged_remarks(df: DataFrame, column: str = "remark") -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows whose remark is empty, plain text or a JSON object; those with a broken object, with a reason."""
    text = F.trim(column)
    braced = F.coalesce(F.startswith(text, F.lit("{")), F.lit(False))
    broken = braced & F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).isNull()
    return df.where(~broken), df.where(broken).withColumn("reason", F.lit("remark: no JSON object"))


def judged_days(df: DataFrame, column: str, pattern: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows whose text is a date, as one; the others, with a reason (empty cells are neither)."""
    text, day = F.trim(column), F.try_to_date(F.trim(column), pattern)
    there = df.where(F.coalesce(text, F.lit("")) != "")
    return there.where(day.isNotNull()).withColumn(column, day), there.where(day.isNull()).withColumn("reason", F.lit(f"{column}: not a date"))


#: The metric that rows of a dataset must have.
METRICS = {"index_universe": "universe", "trade_status": "交易状态", "trade_calendar": "交易日"}


def broken_rules(dataset: str) -> dict[str, Column]:
    """What rows (datetime, code, metric, value, remark as a map) of a dataset may not be, by reason."""
    remark = lambda k: F.coalesce(F.trim(F.col("remark")[k]), F.lit(""))
    value, metric = F.col("value"), ~F.coalesce(F.col("metric") == METRICS.get(dataset, ""), F.lit(False))
    listed = F.from_json(F.col("remark")["constituents"], "array<string>")
    rules = {
        "industry": {"industry name missing": remark("ind_name") == "", "industry code missing": remark("ind_code") == ""},
        "index_universe": {"metric": metric, "no list of constituents": listed.isNull(), "value is not the number of different constituents": listed.isNotNull() & ~F.coalesce(value == F.size(F.array_distinct(listed)), F.lit(False))},
        "trade_status": {"metric": metric, "value is neither 0 nor 1": ~F.coalesce(value.isin(0, 1), F.lit(False))},
        "trade_calendar": {"metric": metric, "value is not 1": ~F.coalesce(value == 1, F.lit(False)), "not a date": ~F.coalesce(F.col("datetime") == F.date_trunc("day", "datetime"), F.lit(False)), "exchange not normalised": ~F.coalesce(F.col("code") == F.upper(F.trim("code")), F.lit(False))},
    }
    if dataset not in rules:
        raise ValueError(f"no rules for {dataset}")
    return rules[dataset]


def judged_rows(df: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows by the dataset's rules; a rejected row comes once a reason."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for reason, bad in broken_rules(dataset).items()]))
    judged = df.withColumn("__e", found)
    return judged.where(F.size("__e") == 0).drop("__e"), judged.where(F.size("__e") > 0).withColumn("reason", F.explode("__e")).drop("__e")


def event_rows(df: DataFrame, date: str = "date", event: str = "event", remark: str = "remark") -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of a table of texts: times to the second of rows whose flag is 1; rows whose time can't be read."""
    time = F.date_trunc("second", F.try_to_timestamp(F.trim(date)))
    rows = df.select(F.col(date).alias("text"), time.alias("time"), F.trim(event).alias("flag"), F.col(remark).alias("remark"))
    marked = F.coalesce(F.expr("try_cast(flag AS double)") == 1, F.lit(False))
    return rows.where(F.col("time").isNotNull() & marked).select("time", "remark"), rows.where(F.col("time").isNull()).select("text", "flag", "remark")


def name_span(text: Column) -> Column:
    """`name(20180711-20250101)` as a struct of name, first and last; a text of another form is a name without dates."""
    form = r"^(.*)\((\d{8})-(\d{8})\)\s*$"
    day = lambda k: F.try_to_date(F.regexp_extract(text, form, k), "yyyyMMdd")
    name = F.when(F.regexp_like(text, F.lit(form)), F.regexp_extract(text, form, 1)).otherwise(text)
    return F.struct(F.trim(name).alias("name"), day(2).alias("first"), day(3).alias("last"))


def json_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "rows") -> DataFrame:
    """One row a key: its rows as a JSON array of objects, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("__o")))), lambda r: r["__o"])
    return df.groupBy(*keys).agg(F.to_json(listed).alias(name))


def json_object(df: DataFrame, keys: list[str], field: str, value: str, name: str = "fields") -> DataFrame:
    """One row a key: a JSON object of its fields, in order of their names (of a repeated field the largest value)."""
    one = df.groupBy(*keys, field).agg(F.max(value).alias(value))
    return one.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value))))).alias(name))
