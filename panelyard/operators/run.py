"""A factor's whole run as one plan: universe, tradability, cleaning with diagnostics, groups, weights, whole lots, value.

The steps are the operators of this package; here is only their order. Every step stays partitioned by date or by code,
but for the recursion of wealth, which needs a row a portfolio (see backtest.integer_lots)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import backtest, cross_section
from panelyard.operators.asof import in_universe
from panelyard.operators.evaluation import guarded_corr


@dataclass(frozen=True)
class Spec:
    """How a run cleans, groups and trades. None leaves a step out."""

    groups: int = 5
    clip: tuple[str, float] | None = ("mad", 3.0)
    scale: str | None = "zscore"
    group: str | None = "industry"
    control: str | None = "log_cap"
    long: tuple[int, ...] = (4,)
    short: tuple[int, ...] = ()
    amount: float = 1e6
    lot: int = 100


def preprocessed(df: DataFrame, x: str, spec: Spec, date: str = "date") -> DataFrame:
    """Rows with x, clipped, scaled and neutralised by date as the spec says, to ten digits; `raw` is x before."""
    out = df.where(F.col(x).isNotNull()).withColumn("raw", F.col(x))
    if spec.clip:
        out = cross_section.winsorize(out, x, *spec.clip, date)
    if spec.scale:
        out = cross_section.standardize(out, x, spec.scale, date)
    if spec.group or spec.control:
        out = cross_section.neutralize(out, x, spec.group, spec.control, date)
    return out.withColumn(x, F.round(x, 10))


def diagnostics(df: DataFrame, x: str, group: str, control: str, date: str = "date") -> DataFrame:
    """(date, n, corr_raw, corr, group_raw, group): what cleaning did: correlation with the control, and the mean size of
    the groups' means, before and after (before: of the standardised raw values)."""
    w = Window.partitionBy(date)
    scaled = df.withColumn("__r", F.try_divide(F.col("raw") - F.avg("raw").over(w), F.nullif(F.stddev_samp("raw").over(w), F.lit(0.0))))
    cell = Window.partitionBy(date, group)
    first = F.row_number().over(cell.orderBy(F.lit(1))) == 1
    sized = scaled.withColumns({"__a": F.abs(F.avg("__r").over(cell)), "__b": F.abs(F.avg(x).over(cell)), "__f": first & F.col(group).isNotNull()})
    return sized.groupBy(date).agg(
        F.count("*").alias("n"), guarded_corr("__r", control).alias("corr_raw"), guarded_corr(x, control).alias("corr"),
        F.avg(F.when(F.col("__f"), F.col("__a"))).alias("group_raw"), F.avg(F.when(F.col("__f"), F.col("__b"))).alias("group"),
    )


def chosen_weights(df: DataFrame, labels: list[str], long: list[tuple], short: list[tuple] = (), date: str = "date") -> DataFrame:
    """Adds weight: 1 in equal parts on rows whose labels are one of the combinations `long`, -1 on those of `short`."""
    among = lambda wanted: F.array_contains(F.array(*[F.array(*map(F.lit, c)) for c in wanted]), F.array(*labels)) if wanted else F.lit(False)
    side = df.withColumn("__s", F.when(F.coalesce(among(long), F.lit(False)), 1).when(F.coalesce(among(short), F.lit(False)), -1).otherwise(0))
    return side.withColumn("weight", F.col("__s") / F.count("*").over(Window.partitionBy(date, "__s"))).drop("__s")


def targets(values: DataFrame, spec: Spec) -> DataFrame:
    """(date, code, weight) of the groups that the spec buys and sells."""
    labelled = cross_section.quantile_label(values, "x", spec.groups).where("label IS NOT NULL")
    return chosen_weights(labelled, ["label"], [(k,) for k in spec.long], [(k,) for k in spec.short]).where("weight <> 0").select("date", "code", "weight")


def admitted(values: DataFrame, universe: DataFrame, tradable: DataFrame | None = None, always: tuple = ()) -> DataFrame:
    """Rows of the universe's members that can be traded; codes in `always` come in without being members."""
    member = values.join(universe.select("date", "code", F.lit(True).alias("__in")).distinct(), ["date", "code"], "left").where(F.coalesce("__in", F.lit(False)) | F.col("code").isin(*always)).drop("__in")
    return in_universe(member, tradable) if tradable is not None else member


def traded(weights: DataFrame, prices: DataFrame, spec: Spec, mask: Column | None = None) -> DataFrame:
    """Lots and wealth of the weights. prices: code, date, price; every code with a price has a row at each rebalance.
    mask: a condition on the date; where it doesn't hold, all is cash."""
    dates = weights.select("date").distinct()
    full = prices.where(F.col("price") > 0).join(dates, "date", "left_semi").join(weights, ["date", "code"], "left")
    kept = F.coalesce("weight", F.lit(0.0))
    kept = F.when(mask, kept).otherwise(0.0) if mask is not None else kept
    return backtest.integer_lots(full.select(F.lit("run").alias("portfolio"), "date", "code", kept.alias("weight"), "price"), spec.amount, spec.lot)


def book(lots: DataFrame, prices: DataFrame, spec: Spec) -> DataFrame:
    """(portfolio, date, value, cash, nav) on every bar."""
    held = backtest.lot_positions(lots, prices.select("code", "date", F.col("price").alias("close")), spec.lot)
    return backtest.lot_book(lots, held, spec.lot)
