"""From labels to portfolios and what they hold: pools, sorts by many factors, checks, rebalances, positions, trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.cross_section import quantile_label


def tradable(status: DataFrame, include_abnormal: bool = False) -> DataFrame:
    """(date, code) that can be traded: those of normal status, or all that are listed."""
    return status.where("status <> -1" if include_abnormal else "status = 1").select("date", "code")


def sorted_by(df: DataFrame, steps: list[tuple[str, int, bool]], date: str = "date") -> DataFrame:
    """label_1, label_2, ... of factors (column, groups, dependent); a dependent sort stands within the label before it.
    Rows need all values."""
    for x, _, _ in steps:
        df = df.where(F.col(x).isNotNull())
    for k, (x, n, dependent) in enumerate(steps, 1):
        df = quantile_label(df, x, n, f"label_{k}", (date, f"label_{k - 1}") if dependent and k > 1 else (date,))
    return df


def combination_weights(df: DataFrame, labels: list[str], date: str = "date") -> DataFrame:
    """1 shared equally by the rows that are in the top group of every label, -1 by those in the bottom one of each."""
    w = Window.partitionBy(date)
    high, low = F.lit(True), F.lit(True)
    for c in labels:
        df = df.withColumns({f"__t_{c}": F.max(c).over(w), f"__b_{c}": F.min(c).over(w)})
        high, low = high & (F.col(c) == F.col(f"__t_{c}")), low & (F.col(c) == F.col(f"__b_{c}"))
    df = df.withColumn("__s", F.when(high & low, 0).when(high, 1).when(low, -1).otherwise(0))
    out = df.withColumn("weight", F.col("__s") / F.count("*").over(Window.partitionBy(date, "__s")))
    return out.drop("__s", *(f"__{k}_{c}" for c in labels for k in "tb"))


def expanded(weights: DataFrame, date: str = "date", code: str = "code") -> DataFrame:
    """A row for every code that ever had one, at every date: weight 0 where it has none."""
    dates = weights.agg(F.collect_set(date).alias("__d"))
    every = weights.select(code).distinct().join(F.broadcast(dates)).select(code, F.explode("__d").alias(date))
    return every.join(weights.select(date, code, "weight"), [date, code], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def pool_check(weights: DataFrame, pool: DataFrame, most: int = 20, date: str = "date", code: str = "code") -> DataFrame:
    """(date, pool_size, selected, outside, sample, passed): selected codes that were not in the date's pool."""
    size = pool.groupBy(date).agg(F.count("*").alias("pool_size"))
    held = weights.where("weight <> 0").join(pool.select(date, code, F.lit(True).alias("__in")), [date, code], "left")
    out = F.col("__in").isNull()
    found = held.groupBy(date).agg(F.count("*").alias("selected"), F.count_if(out).alias("outside"), F.slice(F.array_sort(F.collect_list(F.when(out, F.col(code)))), 1, most).alias("sample"))
    return found.join(size, date, "left").select(date, F.coalesce("pool_size", F.lit(0)).alias("pool_size"), "selected", "outside", "sample", (F.col("outside") == 0).alias("passed"))


def residual(df: DataFrame, y: str, x: str, least: int = 10, date: str = "date") -> DataFrame:
    """y less its regression on x across codes, of dates with enough codes that have both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(date)
    slope = F.coalesce(F.try_divide(F.covar_samp(x, y).over(w), F.nullif(F.var_samp(x).over(w), F.lit(0.0))), F.lit(0.0))
    out = both.withColumn("__b", slope).withColumn("__n", F.count("*").over(w))
    return out.withColumn("residual", F.col(y) - F.avg(y).over(w) - F.col("__b") * (F.col(x) - F.avg(x).over(w))).where(F.col("__n") >= least).drop("__b", "__n")


def group_diagnostics(df: DataFrame, x: str, group: str, date: str = "date") -> DataFrame:
    """(date, group, n, missing, share): how many rows and missing values each group has, and its share of the date."""
    found = df.groupBy(date, F.coalesce(F.col(group).cast("string"), F.lit("none")).alias("group")).agg(F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("missing"))
    return found.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(date)))


def weight_report(weights: DataFrame, date: str = "date", code: str = "code") -> DataFrame:
    """One row about a table of weights: its size, missing and infinite weights, repeated keys, dates of gross over 1."""
    w = F.col("weight")
    keys = weights.groupBy(date, code).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated"))
    gross = weights.groupBy(date).agg(F.sum(F.abs(w)).alias("g")).agg(F.count("*").alias("dates"), F.count_if(F.col("g") > 1 + 1e-9).alias("over_one"))
    return weights.agg(F.count("*").alias("rows"), F.count_if(w.isNull()).alias("missing"), F.count_if(F.isnan(w) | (F.abs(w) == float("inf"))).alias("bad")).join(F.broadcast(keys)).join(F.broadcast(gross))


def held_over(weights: DataFrame, status: DataFrame, date: str = "date") -> DataFrame:
    """Weights by the rule `hold`: on a date with a suspended holding all weights are those of the last date without one;
    before the first such date all is cash. weights has a row for every code at every rebalance."""
    joined = weights.join(status.select(date, "code", "status"), [date, "code"], "left")
    halted = joined.groupBy(date).agg(F.max((F.col("weight") != 0) & (F.coalesce("status", F.lit(1)) == 0)).alias("__h"))
    source = F.last(F.when(~F.col("__h"), F.col(date)), ignorenulls=True).over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0))  # one row a rebalance
    dates = halted.select(F.col(date).alias("__to"), source.alias(date))
    copied = dates.join(weights, date).select(F.col("__to").alias(date), "code", "weight")
    return weights.select(date, "code").join(copied, [date, "code"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def period_returns(prices: DataFrame, price: str = "price", code: str = "code", date: str = "date") -> DataFrame:
    """The change of each code's price since the rebalance before; 0 where there is none."""
    before = F.lag(price).over(Window.partitionBy(code).orderBy(date))
    return prices.withColumn("ret", F.coalesce(F.try_divide(F.col(price), before) - 1, F.lit(0.0)))


def positions(weights: DataFrame, closes: DataFrame, amount: float, code: str = "code", date: str = "date") -> DataFrame:
    """(date, code, shares, close, value, pnl): shares bought at each rebalance (weight times amount at its price), held
    until the next; pnl is that of the shares held since the bar before. weights lists every code at every rebalance."""
    w = Window.partitionBy(code).orderBy(date)
    joined = closes.join(weights.select(date, code, "weight"), [date, code], "left").withColumn("__c", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bought = F.when(F.col("weight").isNotNull(), F.coalesce(F.try_divide(F.col("weight") * amount, F.col("__c")), F.lit(0.0)))
    held = joined.withColumn("shares", F.coalesce(F.last(bought, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).withColumn("__c", F.coalesce("__c", F.lit(0.0)))
    pnl = F.coalesce(F.lag("shares").over(w) * (F.col("__c") - F.lag("__c").over(w)), F.lit(0.0))
    return held.select(date, code, "shares", F.col("__c").alias("close"), (F.col("shares") * F.col("__c")).alias("value"), pnl.alias("pnl"))


def book(held: DataFrame, amount: float, date: str = "date") -> DataFrame:
    """(date, value, pnl, nav): what all positions are worth, and the amount with all gains over the amount."""
    daily = held.groupBy(date).agg(F.sum("value").alias("value"), F.sum("pnl").alias("pnl"))
    return daily.withColumn("nav", 1 + F.sum("pnl").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)) / amount)  # one row a bar


def group_navs(returns: DataFrame, label: str = "label", date: str = "date") -> DataFrame:
    """The compounded growth of each group's mean returns; nothing is lost beyond all."""
    w = Window.partitionBy(label).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("nav", F.exp(F.sum(F.log1p(F.greatest(F.coalesce("ret", F.lit(0.0)), F.lit(-0.999999)))).over(w)))


def top_holdings(weights: DataFrame, n: int, code: str = "code") -> DataFrame:
    """(code, mean, periods): the codes of the largest mean absolute weight."""
    return weights.where("weight <> 0").groupBy(code).agg(F.avg(F.abs("weight")).alias("mean"), F.count("*").alias("periods")).orderBy(F.desc(F.round("mean", 12)), code).limit(n)


def holding_spans(weights: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """(code, spans, mean_length): runs of rebalances at which a code was held. weights has all codes at all rebalances."""
    w = Window.partitionBy(code).orderBy(date)
    on = F.col("weight") != 0
    started = on & ~F.coalesce(F.lag(on).over(w), F.lit(False))
    return weights.withColumn("__s", started.cast("int")).where(on).groupBy(code).agg(F.sum("__s").alias("spans"), (F.count("*") / F.sum("__s")).alias("mean_length"))


def contributions(weights: DataFrame, returns: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """(code, contribution): the sum over bars of the weight before times the return."""
    before = F.lag("weight").over(Window.partitionBy(code).orderBy(date))
    joined = returns.join(weights.select(date, code, "weight"), [date, code], "left").withColumn("__b", before)
    return joined.groupBy(code).agg(F.sum(F.coalesce(F.col("__b") * F.col("ret"), F.lit(0.0))).alias("contribution"))


def trade_pairs(trades: DataFrame, order: list[str], code: str = "code") -> DataFrame:
    """(code, n, bought, sold): each sell with the buy that waited longest; sells with no buy waiting are dropped.

    trades: code, side (buy or sell), time, and the columns that order them. What waits is the running balance above its
    running minimum, so a sell counts unless it takes the balance to a new minimum below 0: no row-by-row state."""
    w = Window.partitionBy(code).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    balance = trades.withColumn("__d", F.sum(F.when(F.col("side") == "buy", 1).otherwise(-1)).over(upto))
    balance = balance.withColumn("__low", F.coalesce(F.min("__d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    live = balance.where((F.col("side") == "buy") | (F.col("__d") >= F.least("__low", F.lit(0))))
    numbered = live.withColumn("n", F.row_number().over(Window.partitionBy(code, "side").orderBy(*order)))
    pair = numbered.groupBy(code, "n").agg(F.max(F.when(F.col("side") == "buy", F.col("time"))).alias("bought"), F.max(F.when(F.col("side") == "sell", F.col("time"))).alias("sold"))
    return pair.where("sold is not null")


def regrouped(weights: DataFrame, per_day: int = 10, most: int = 25, date: str = "date", code: str = "code") -> DataFrame:
    """Weights by date with all codes but the leading ones under `other`, and what is left under `cash`: leading are the
    codes among a date's `per_day` largest, at most `most` of them by their peak weight."""
    w = Window.partitionBy(date).orderBy(F.desc("weight"), code)
    daily = weights.where("weight > 0").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_day)
    chosen = daily.groupBy(code).agg(F.max("weight").alias("__p")).orderBy(F.desc("__p"), code).limit(most).select(code, F.lit(True).alias("__in"))
    named = weights.join(chosen, code, "left").groupBy(date, F.when(F.col("__in"), F.col(code).cast("string")).otherwise("other").alias("name")).agg(F.sum("weight").alias("weight"))
    return named.unionByName(weights.groupBy(date).agg((1 - F.sum("weight")).alias("weight")).select(date, F.lit("cash").alias("name"), "weight"))


def rebalance_table(df: DataFrame, x: str, label: str = "label", date: str = "date", code: str = "code") -> DataFrame:
    """(date, code, weight, value, group, rank) of the holdings: groups from 1, ranks by the factor from the largest."""
    rank = F.row_number().over(Window.partitionBy(date).orderBy(F.desc(F.round(x, 10)), code))
    return df.withColumn("rank", rank).where("weight <> 0").select(date, code, "weight", F.col(x).alias("value"), (F.col(label) + 1).alias("group"), "rank")


def trade_segments(df: DataFrame, ret: str, weight: str = "weight", code: str = "code", date: str = "date") -> DataFrame:
    """(code, segment, side, start, end, length, ret): runs of one side, with the compounded return of the side taken."""
    w = Window.partitionBy(code).orderBy(date)
    side = F.signum(F.coalesce(weight, F.lit(0.0))).cast("int")
    runs = df.withColumn("side", side).withColumn("__c", F.coalesce((F.col("side") != F.lag("side").over(w)).cast("int"), F.lit(1)))
    runs = runs.withColumn("segment", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("side <> 0")
    gain = F.log1p(F.greatest(F.col("side") * F.coalesce(ret, F.lit(0.0)), F.lit(-0.999999)))
    return runs.groupBy(code, "segment", "side").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("length"), (F.exp(F.sum(gain)) - 1).alias("ret"))


def position_table(held: DataFrame, date: str = "date") -> DataFrame:
    """Positions that aren't 0 with their shares of the date's value and of its absolute gains."""
    w = Window.partitionBy(date)
    share = lambda x, of: F.try_divide(x, F.nullif(F.sum(of).over(w), F.lit(0.0)))
    return held.withColumns({"weight_share": share(F.col("value"), F.col("value")), "pnl_share": share(F.abs("pnl"), F.abs("pnl"))}).where("shares <> 0")


def annual_report(navs: DataFrame, least: int = 5, series: str = "code", date: str = "date") -> DataFrame:
    """(series, year, n, total, volatility, max_drawdown) of years with enough points."""
    key = [series, F.year(date).alias("year")]
    w = Window.partitionBy(series, F.year(date)).orderBy(date)
    df = navs.withColumn("__r", F.try_divide(F.col("nav"), F.lag("nav").over(w)) - 1).withColumn("__d", F.try_divide(F.col("nav"), F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    out = df.groupBy(*key).agg(F.count("*").alias("n"), (F.max_by("nav", date) / F.min_by("nav", date) - 1).alias("total"), F.stddev_samp("__r").alias("volatility"), F.min("__d").alias("max_drawdown"))
    return out.where(F.col("n") >= least)


def last_days(calendar: DataFrame, first: int, last: int, date: str = "date") -> DataFrame:
    """Trading dates from the `first`-th to the `last`-th before a month's end; months of fewer dates have none."""
    w = Window.partitionBy(F.date_trunc("month", date))
    placed = calendar.select(date).distinct().withColumn("__n", F.row_number().over(w.orderBy(F.desc(date)))).withColumn("__k", F.count("*").over(w))
    return placed.where((F.col("__n") <= first) & (F.col("__n") >= last) & (F.col("__k") >= first)).select(date)


def segment_metrics(segments: DataFrame) -> DataFrame:
    """(side, segments, wins, mean, mean_length, best, worst) of the trade segments of each side."""
    r = F.col("ret")
    return segments.groupBy("side").agg(F.count("*").alias("segments"), F.avg((r > 0).cast("double")).alias("wins"), F.avg(r).alias("mean"), F.avg("length").alias("mean_length"), F.max(r).alias("best"), F.min(r).alias("worst"))


def stock_and_cash(weights: DataFrame, date: str = "date", code: str = "code") -> DataFrame:
    """(date, stock, cash, primary): what is held and what is left, and the code of the largest weight by size."""
    size = F.round(F.abs("weight"), 12)
    return weights.groupBy(date).agg(F.sum(F.abs("weight")).alias("stock"), (1 - F.sum("weight")).alias("cash"), F.max_by(code, F.struct(size, -F.col(code))).alias("primary"))
