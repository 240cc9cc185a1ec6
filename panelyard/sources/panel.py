"""Panels of bars from trade lines, in Spark and in SQL.

A bar's open and close are the unit prices of its first and last line (by time, order, line number), high and low the
extreme unit prices, volume and amount the sums; vwap = amount / volume; returns = close / previous close - 1. The panel
is dense: every code has a row for every date, with NULLs where it did not trade.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("open", "high", "low", "close", "volume", "amount", "vwap", "returns", "cap", "subindustry", "industry", "sector")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(lines: DataFrame, code: str, every: str) -> DataFrame:
    """code, date and the prices of each traded bar. lines: l_* columns and the column `code`; every: month or week.

    Of lines of one time, order and number the one with the smallest supplier (then price) is first, and also last, so that a
    bar doesn't depend on where its lines lie."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = ("l_shipdate", "l_orderkey", "l_linenumber")
    first, last = F.struct(*order, "l_suppkey", unit), F.struct(*order, -F.col("l_suppkey"), -unit)
    return lines.groupBy(F.col(code).cast("long").alias("code"), F.trunc("l_shipdate", every).alias("date")).agg(
        F.min_by(unit, first).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.max_by(unit, last).alias("close"),
        F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )


def dense(traded: DataFrame) -> DataFrame:
    """Every code on every date. Dates and codes are small next to the bars, their product is the panel itself."""
    codes, dates = traded.select("code").distinct(), traded.select("date").distinct()
    everyone = codes.withColumn("k", F.lit(1)).join(F.broadcast(dates.agg(F.sort_array(F.collect_list("date")).alias("dates"))).withColumn("k", F.lit(1)), "k")
    return everyone.select("code", F.explode("dates").alias("date")).join(traded, ["code", "date"], "left")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where none is set (tests), a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: So many rows, about, are what a task sorts or groups where `spread` deals them.
ROWS_A_TASK = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The table dealt by its keys over as many tasks as its `rows` ask for. Partitions that Spark merges by their compressed
    bytes hold millions of narrow rows, and what a task sorts or groups grows with them."""
    return df.repartition(-(-rows // ROWS_A_TASK) or 1, *keys)


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there: queries that use a table several times don't
    compute it several times, and a lost executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def panel(spark: SparkSession, sf_dir: str, every: str = "month", once: bool = False, only: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Months: one code per supplier. Weeks: one code per nation, for formulas that look back far. once: trade lines are
    read once, and the panel is kept, for queries that read it several times. only: the columns beside code and date; without
    open, close and returns lines are summed as they come, not sorted, and a kept panel is as narrow as its query needs."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    if every == "month":
        traded = bars(lines, "l_suppkey", "month")
        facts = suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").cast("long").alias("code"), (F.col("s_acctbal") + 1e5).alias("cap"), F.when(F.col("s_suppkey") % 17 != 0, F.col("s_nationkey")).cast("long").alias("subindustry"),
            F.when(F.col("s_suppkey") % 17 != 0, F.col("s_nationkey") % 5).cast("long").alias("industry"), F.when(F.col("s_suppkey") % 17 != 0, F.col("n_regionkey")).cast("long").alias("sector"),
        )
    else:
        traded = bars(lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey", every)
        facts = suppliers.groupBy("s_nationkey").agg(F.round(F.sum("s_acctbal") + 1e6, 2).alias("cap")).join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_nationkey").cast("long").alias("code"), "cap", (F.col("s_nationkey") % 10).cast("long").alias("subindustry"), (F.col("s_nationkey") % 5).cast("long").alias("industry"), F.col("n_regionkey").cast("long").alias("sector"),
        )
    before = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    derived = {"vwap": F.try_divide("amount", "volume").alias("vwap"), "returns": (F.try_divide("close", before) - 1).alias("returns")}
    needed = {"vwap": ("amount", "volume"), "returns": ("close",)}
    sources = {c for name in only for c in needed.get(name, (name,))}
    traded = traded.select("code", "date", *(c for c in traded.columns[2:] if c in sources))
    full = dense(kept(traded) if once else traded)
    if sources & set(facts.columns):
        full = full.join(facts, "code", "left")
    whole = full.select("code", "date", *(derived.get(c, F.col(c)) for c in only))
    return kept(whole) if once else whole


def panel_sql(every: str = "month") -> str:
    """Common table expressions that end in `panel`, for the same rows."""
    lines = "lineitem" if every == "month" else "lineitem JOIN supplier ON l_suppkey = s_suppkey"
    code = "l_suppkey" if every == "month" else "s_nationkey"
    if every == "month":
        facts = """SELECT s_suppkey AS code, s_acctbal + 1e5 AS cap, CASE WHEN s_suppkey % 17 <> 0 THEN s_nationkey END AS subindustry,
  CASE WHEN s_suppkey % 17 <> 0 THEN s_nationkey % 5 END AS industry, CASE WHEN s_suppkey % 17 <> 0 THEN n_regionkey END AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
    else:
        facts = """SELECT s_nationkey AS code, round(sum(s_acctbal) + 1e6, 2) AS cap, s_nationkey % 10 AS subindustry, s_nationkey % 5 AS industry, any_value(n_regionkey) AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey"""
    return f"""line AS (SELECT {code} AS code, CAST(date_trunc('{every}', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS u, l_quantity, l_extendedprice, l_shipdate, l_orderkey, l_linenumber FROM {lines}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY l_shipdate, l_orderkey, l_linenumber) AS a, row_number() OVER (PARTITION BY code, date ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS z FROM line),
traded AS (SELECT code, date, max(u) FILTER (a = 1) AS open, max(u) AS high, min(u) AS low, max(u) FILTER (z = 1) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount FROM numbered GROUP BY code, date),
facts AS ({facts}),
everyone AS (SELECT code, date FROM (SELECT DISTINCT code FROM traded), (SELECT DISTINCT date FROM traded)),
panel AS (SELECT e.code, e.date, open, high, low, close, volume, amount, amount / nullif(volume, 0) AS vwap,
  close / nullif(lag(close) OVER (PARTITION BY e.code ORDER BY e.date), 0) - 1 AS returns, cap, subindustry, industry, sector
  FROM everyone e LEFT JOIN traded t ON e.code = t.code AND e.date = t.date LEFT JOIN facts f ON f.code = e.code)"""
