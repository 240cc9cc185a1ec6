"""Portfolio back-tests over daily bars, for many portfolios at once: (portfolio, date, code, weight) rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.asof import nearest


def vector(weights: DataFrame, prices: DataFrame, portfolio: str = "portfolio") -> DataFrame:
    """(portfolio, date, ret, nav): each bar earns the weights that held at the end of the bar before.

    weights lists every code at every rebalance (0 where it is not held); prices: code, date, ret."""
    pairs = weights.select(portfolio, "code").distinct()
    probes = pairs.join(prices.select("code", F.col("date").alias("input_ts"), "ret"), "code").withColumn("key", F.struct(portfolio, "code"))
    facts = weights.select(F.struct(portfolio, "code").alias("key"), F.col("date").alias("datetime"), "weight")
    held = nearest(probes.select("key", "input_ts", "ret"), facts, "before", None, "key").select("key.*", F.col("input_ts").alias("date"), "ret", "weight")
    before = F.coalesce(F.lag("weight").over(Window.partitionBy(portfolio, "code").orderBy("date")), F.lit(0.0))
    daily = held.withColumn("__r", before * F.coalesce(F.col("ret"), F.lit(0.0))).groupBy(portfolio, "date").agg(F.sum("__r").alias("ret"))
    growth = F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(Window.partitionBy(portfolio).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("nav", F.exp(growth))


def integer_lots(weights: DataFrame, amount: float, lot: int = 100, portfolio: str = "portfolio") -> DataFrame:
    """(portfolio, date, code, price, lots, actual, wealth): whole lots bought at each rebalance from the wealth there,
    which grows by the actual holdings' returns until the next one; what lots can't use stays cash.

    weights: portfolio, date, code, weight, price, with a row for every code that is or was held at every rebalance; a code
    without a row at the next one earns nothing. Only what the recursion needs (weight, price and return of the holdings, by
    rebalance) forms a row a portfolio, and folds there; everything else stays spread over (portfolio, date, code)."""
    by_code = Window.partitionBy(portfolio, "code").orderBy("date")
    dates = weights.select(portfolio, "date").distinct().withColumn("__next", F.lead("date").over(Window.partitionBy(portfolio).orderBy("date")))
    rows = weights.join(dates, [portfolio, "date"]).withColumn("__ret", F.when(F.lead("date").over(by_code) == F.col("__next"), F.try_divide(F.lead("price").over(by_code), F.col("price")) - 1))
    held = (F.col("weight") != 0) & (F.col("price") > 0)
    each = rows.groupBy(portfolio, "date").agg(F.sort_array(F.collect_list(F.when(held, F.struct("code", F.col("weight").cast("double").alias("w"), F.col("price").cast("double").alias("p"), F.coalesce("__ret", F.lit(0.0)).alias("r"))))).alias("h"))
    history = each.groupBy(portfolio).agg(F.sort_array(F.collect_list(F.struct("date", "h"))).alias("t"))

    def grown(wealth: Column, holdings: Column) -> Column:
        whole = lambda v: v - v % 1  # noqa: E731  toward zero
        bought = lambda x: F.coalesce(whole(F.try_divide(x["w"] * wealth, x["p"] * lot)), F.lit(0.0)) * lot * x["p"]
        return wealth + F.aggregate(holdings, F.lit(0.0), lambda s, x: s + bought(x) * x["r"])

    start = F.struct(F.lit(float(amount)).alias("a"), F.array().cast("array<double>").alias("all"))
    path = F.aggregate("t", start, lambda s, t: F.struct(grown(s["a"], t["h"]).alias("a"), F.array_append(s["all"], s["a"]).alias("all")), lambda s: s["all"])
    wealth = history.select(portfolio, F.explode(F.arrays_zip(F.transform("t", lambda t: t["date"]).alias("date"), path.alias("wealth"))).alias("z")).select(portfolio, "z.date", "z.wealth")
    priced = weights.join(wealth, [portfolio, "date"])
    lots = F.coalesce(F.when(F.col("price") > 0, F.try_divide(F.col("weight") * F.col("wealth"), F.col("price") * lot)).try_cast("bigint"), F.lit(0))
    out = priced.withColumn("lots", lots)
    return out.select(portfolio, "date", "code", "price", "lots", F.coalesce(F.try_divide(F.col("lots") * lot * F.col("price"), F.col("wealth")), F.lit(0.0)).alias("actual"), "wealth")


def lot_positions(lots: DataFrame, closes: DataFrame, lot: int = 100, portfolio: str = "portfolio") -> DataFrame:
    """(portfolio, date, code, shares, close, value, pnl) on every bar from a portfolio's first rebalance on: the shares of
    the latest rebalance at the last known close; pnl is that of the shares held since the bar before."""
    pairs = lots.groupBy(portfolio, "code").agg(F.min("date").alias("__first"))
    w = Window.partitionBy(portfolio, "code").orderBy("date")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    bars = pairs.join(closes.select("code", "date", "close"), "code").join(lots.select(portfolio, "code", "date", "lots"), [portfolio, "code", "date"], "left")
    held = bars.withColumns({"shares": F.coalesce(F.last("lots", True).over(up_to), F.lit(0)) * lot, "close": F.last("close", True).over(up_to)})
    pnl = F.coalesce(F.lag("shares").over(w) * (F.col("close") - F.lag("close").over(w)), F.lit(0.0))
    return held.withColumn("pnl", pnl).where(F.col("date") >= F.col("__first")).select(portfolio, "date", "code", "shares", "close", F.coalesce(F.col("shares") * F.col("close"), F.lit(0.0)).alias("value"), "pnl")


def lot_book(lots: DataFrame, held: DataFrame, lot: int = 100, portfolio: str = "portfolio") -> DataFrame:
    """(portfolio, date, value, cash, nav): what the positions and the cash that the latest rebalance left are worth, over
    the first wealth."""
    left = lots.groupBy(portfolio, "date").agg((F.max("wealth") - F.sum(F.coalesce(F.col("lots") * lot * F.col("price"), F.lit(0.0)))).alias("cash"), F.max("wealth").alias("__a"))
    w = Window.partitionBy(portfolio).orderBy("date")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    daily = held.groupBy(portfolio, "date").agg(F.sum("value").alias("value")).join(left, [portfolio, "date"], "left")
    filled = daily.withColumns({"cash": F.last("cash", True).over(up_to), "__a": F.first("__a", True).over(up_to)})
    return filled.select(portfolio, "date", "value", "cash", F.try_divide(F.col("value") + F.col("cash"), F.col("__a")).alias("nav"))


def missing_prices(weights: DataFrame, prices: DataFrame, code: str = "code", date: str = "date") -> tuple[DataFrame, DataFrame]:
    """The weights with 0 for codes that have no price on any date, and those codes; dates without any price are an error."""
    dates = weights.select(date).distinct().join(prices.select(date).distinct(), date, "left_anti")
    lost = dates.orderBy(date).limit(5).collect()
    if lost:
        raise ValueError(f"no price on {dates.count()} dates, among them {[str(r[0]) for r in lost]}")
    absent = weights.select(code).distinct().join(prices.select(code).distinct(), code, "left_anti")
    marked = weights.join(absent.withColumn("__lost", F.lit(True)), code, "left")
    return marked.withColumn("weight", F.when(F.col("__lost"), 0.0).otherwise(F.col("weight"))).drop("__lost"), absent


def trades(lots: DataFrame, portfolio: str = "portfolio") -> DataFrame:
    """(portfolio, date, code, side, change) wherever the number of lots changed."""
    before = F.coalesce(F.lag("lots").over(Window.partitionBy(portfolio, "code").orderBy("date")), F.lit(0))
    return lots.withColumn("change", F.col("lots") - before).where("change != 0").select(portfolio, "date", "code", F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"), "change")


def suspended(weights: DataFrame, status: DataFrame, rule: str = "to_cash", date: str = "date") -> DataFrame:
    """Weights of codes that are suspended (status 0) on a rebalance date: to_cash sets them to 0, redistribute gives
    them to the date's other codes in proportion, as_normal keeps them."""
    joined = weights.join(status.select(date, "code", "status"), [date, "code"], "left").withColumn("__live", F.coalesce("status", F.lit(1)) != 0)
    if rule == "as_normal":
        return joined.drop("status", "__live")
    kept = F.when(F.col("__live"), F.col("weight")).otherwise(0.0)
    if rule == "redistribute":
        w = Window.partitionBy(date)
        kept = F.coalesce(F.try_divide(kept * F.sum("weight").over(w), F.nullif(F.sum(kept).over(w), F.lit(0.0))), F.lit(0.0))
    elif rule != "to_cash":
        raise ValueError(rule)
    return joined.withColumn("weight", kept).drop("status", "__live")
