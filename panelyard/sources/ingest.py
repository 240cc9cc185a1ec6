"""Reading and shaping observation files: long and wide tables, column maps, rejected rows with reasons, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that stand for a missing number.
MISSING = ("", "n/a", "na", "nan", "null", "none", "--", "-")
#: When a metric of a day is known; all others are known after the close.
AVAILABLE = {"open": "09:30:01", "prev_close": "09:30:01"}
CLOSE = "15:00:01"


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    return spark.read.csv(path, header=True, encoding=encoding, multiLine=False)


def mapped(df: DataFrame, columns: dict[str, str], required: list[str] = ()) -> DataFrame:
    """Renames source columns; unknown sources, clashes and missing required columns are errors."""
    unknown = [c for c in columns if c not in df.columns]
    out = df.withColumnsRenamed({k: v for k, v in columns.items() if k in df.columns})
    missing = [c for c in required if c not in out.columns]
    if unknown or missing or len(set(out.columns)) < len(out.columns):
        raise ValueError(f"unknown columns {unknown}, missing columns {missing}, columns {out.columns}")
    return out


def number(x: str) -> Column:
    text = F.lower(F.trim(F.col(x)))
    return F.when(~text.isin(*MISSING), F.expr(f"try_cast(trim(`{x}`) AS double)"))


def parsed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of long text rows datetime, code, metric, value: rejected rows come once per reason."""
    value, text = number("value"), F.lower(F.trim(F.col("value")))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    errors = F.array_compact(
        F.array(
            F.when(F.try_to_timestamp(F.trim("datetime")).isNull(), F.lit("datetime: not a time")),
            F.when(F.coalesce(F.trim("code"), F.lit("")) == "", F.lit("code: empty")),
            F.when(F.coalesce(F.trim("metric"), F.lit("")) == "", F.lit("metric: empty")),
            F.when(~F.coalesce(text, F.lit("")).isin(*MISSING) & ~F.coalesce(finite, F.lit(False)), F.lit("value: not a finite number")),
        )
    )
    judged = df.withColumn("__e", errors)
    good = judged.where(F.size("__e") == 0).where(value.isNotNull())
    good = good.select(F.try_to_timestamp(F.trim("datetime")).alias("datetime"), F.trim("code").alias("code"), F.trim("metric").alias("metric"), value.alias("value"))
    return good, judged.where(F.size("__e") > 0).select("datetime", "code", "metric", "value", F.explode("__e").alias("reason"))


def melted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide to long: each other column is a metric; empty cells leave no row."""
    values = [c for c in df.columns if c not in keys]
    return df.unpivot(keys, values, "metric", "value").where(F.col("value").isNotNull())


def available_at(df: DataFrame, date: str = "date") -> Column:
    """When a metric of a date is known."""
    time = F.lit(CLOSE)
    for metric, at in AVAILABLE.items():
        time = F.when(F.col("metric") == metric, at).otherwise(time)
    return F.to_timestamp(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), time))


def pivoted(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row a key and one column a metric; of repeated values the largest."""
    return df.groupBy(*keys).pivot("metric", metrics).agg(F.max("value"))


def upserted(stored: DataFrame, staged: DataFrame, keys: list[str], insert_only: bool = False) -> DataFrame:
    """The table after a load: staged values win where they are not NULL, or only fill gaps if `insert_only`."""
    values = [c for c in stored.columns if c not in keys]
    new = staged.select(*keys, *(F.col(c).alias(f"__{c}") for c in values))
    both = stored.join(new, keys, "full")
    return both.select(*keys, *(F.coalesce(*((c, f"__{c}") if insert_only else (f"__{c}", c))).alias(c) for c in values))


def changes(stored: DataFrame, staged: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(state, rows): what a load would do: new, same or changed."""
    old = stored.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "new").when(F.col("__old").eqNullSafe(F.col(value)), "same").otherwise("changed")
    return staged.join(old, keys, "left").groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


def current_names(df: DataFrame) -> DataFrame:
    """(code, name): the latest name that is not empty (of one time the last in order)."""
    return df.where(F.trim("name") != "").groupBy("code").agg(F.max_by("name", F.struct("datetime", "name")).alias("name"))


def page(df: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The next rows by datetime (newest first), code and metric, after the last row of the page before."""
    if after:
        t, c, m = (F.lit(x) for x in after)
        df = df.where((F.col("datetime") < t) | ((F.col("datetime") == t) & ((F.col("code") > c) | ((F.col("code") == c) & (F.col("metric") > m)))))
    return df.orderBy(F.desc("datetime"), "code", "metric").limit(size)


def sparse_status(df: DataFrame, date: str = "date") -> DataFrame:
    """The first normal day of each code, and all its other days."""
    first = F.min(F.when(F.col("status") == 1, F.col(date))).over(Window.partitionBy("code"))
    return df.withColumn("__f", first).where((F.col("status") != 1) | (F.col(date) == F.col("__f"))).drop("__f")


def remarks(df: DataFrame, column: str = "remark", key: str = "text") -> DataFrame:
    """`remark` as a map: a JSON object's fields, or the text itself under a key; an empty one is NULL."""
    text = F.trim(column)
    found = F.from_json(text, "map<string,string>")
    return df.withColumn("remark", F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), found).otherwise(F.create_map(F.lit(key), text)))


def resolved(df: DataFrame, aliases: DataFrame, metric: str = "metric") -> DataFrame:
    """Metrics under their own names. aliases: alias, canonical; a small dictionary, left to Spark to broadcast."""
    return df.join(aliases.select(F.col("alias").alias(metric), "canonical"), metric, "left").withColumn(metric, F.coalesce("canonical", metric)).drop("canonical")


def industry_rows(df: DataFrame) -> DataFrame:
    """(code, date, scheme, value, name) of industry rows date, code, ind_name, ind_code, scheme: the value is the
    number in the industry's code; rows without one are left out."""
    number = F.regexp_extract("ind_code", r"(\d+)", 1)
    return df.where(number != "").select("code", "date", "scheme", number.cast("long").alias("value"), F.col("ind_name").alias("name"))


def snapshots(df: DataFrame, keys: list[str], code: str = "code", ordinal: str = "ordinal") -> DataFrame:
    """One row a snapshot: its constituents as an array in order, and how many there are."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal), F.col(code)))), lambda s: s[code])
    return df.groupBy(*keys).agg(listed.alias("constituents"), F.count("*").alias("n"))


def constituents(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, ordinal) of snapshots whose different constituents are as many as `n` says."""
    some = df.withColumn("constituents", F.array_distinct("constituents")).where(F.size("constituents") == F.col("n"))
    return some.select(*keys, F.posexplode("constituents").alias("ordinal", "code"))


def calendars(df: DataFrame) -> DataFrame:
    """(exchange, date) of a table with one column of dates, as text, for each exchange."""
    long = df.unpivot([], list(df.columns), "exchange", "text")
    return long.select(F.upper(F.trim("exchange")).alias("exchange"), F.try_to_date(F.trim("text"), "yyyy-MM-dd").alias("date")).where("date is not null").distinct()


def report(df: DataFrame, keys: list[str], value: str = "value", ts: str = "datetime") -> DataFrame:
    """One row about a long table before it is loaded: rows, keys that come twice, bad values and times, its range."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated_keys"))
    v = F.col(value)
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct("code").alias("codes"), F.count_distinct("metric").alias("metrics"), F.count_if(v.isNull()).alias("missing_values"),
        F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("bad_values"), F.count_if(F.col(ts).isNull()).alias("missing_times"), F.min(ts).cast("string").alias("first"), F.max(ts).cast("string").alias("last"),
    ).join(F.broadcast(twice))


def without(df: DataFrame, condition: Column, columns: list[str] | None = None) -> DataFrame:
    """The table after a deletion: the rows are gone, or some of their columns are NULL."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in columns}) if columns else df.where(~hit)


def membership(df: DataFrame, code: str = "code", scheme: str = "scheme", ts: str = "datetime") -> DataFrame:
    """(code, scheme, value, valid_from, valid_to): each membership lasts until the next of its code and scheme."""
    w = Window.partitionBy(code, scheme).orderBy(ts)
    return df.select(code, scheme, "value", F.col(ts).alias("valid_from"), F.lead(ts).over(w).alias("valid_to"))


def integrity(df: DataFrame, text: list[str], numbers: list[str]) -> DataFrame:
    """(issue, column, rows) of blank texts and of missing or infinite numbers, in one pass."""
    issues = [F.struct(F.lit("blank").alias("issue"), F.lit(c).alias("column"), (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias("hit")) for c in text]
    issues += [F.struct(F.lit("not finite").alias("issue"), F.lit(c).alias("column"), F.coalesce(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)).alias("hit")) for c in numbers]
    return df.select(F.explode(F.array(*issues)).alias("i")).groupBy("i.issue", "i.column").agg(F.count_if(F.col("i.hit")).alias("rows"))
