"""The whole judgement of a timing factor, for many codes at once: seven rules, their tests in and out of sample, the best
rule's back-test, regression, stability, and a score with a grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.distributions import t_p_value
from panelyard.operators.evaluation import ic_summary
from panelyard.operators.grades import graded
from panelyard.operators.signals import regression, robustness, split, timing_ic

RULES = ("band", "average", "extreme", "sign", "change", "long_average_change", "average_change")
def _zero(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0.0))


def standardized(df: DataFrame, x: str, code: str = "code") -> DataFrame:
    """Rows with x, less the code's mean over its deviation; 0 where it doesn't vary."""
    w = Window.partitionBy(code)
    z = F.coalesce(F.try_divide(F.col(x) - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))), F.lit(0.0))
    return df.where(F.col(x).isNotNull()).withColumn(x, F.round(z, 10))


def seven_rules(df: DataFrame, x: str, window: int, long_window: int, sigma: float = 1.0, extreme: float = 0.1, code: str = "code", date: str = "date") -> DataFrame:
    """df once for each rule: (..., rule, signal in 1, 0, -1). Averages count what there is; mean, deviation and quantiles
    are those of the code's whole series."""
    w, all_ = Window.partitionBy(code).orderBy(date), Window.partitionBy(code)
    mean = lambda n: F.round(F.avg(x).over(w.rowsBetween(-(n - 1), 0)), 10)
    q = F.percentile(x, F.array(F.lit(extreme), F.lit(1 - extreme))).over(all_)
    rows = df.withColumns({"__m": F.avg(x).over(all_), "__s": F.stddev_samp(x).over(all_), "__q": q, "__a": mean(window), "__l": mean(long_window), "__d": F.col(x) - F.lag(x).over(w)})
    rows = rows.withColumns({"__da": F.col("__a") - F.lag("__a").over(w), "__dl": F.col("__l") - F.lag("__l").over(w)})
    v = F.col(x)
    sides = {
        "band": (v > F.col("__m") + sigma * F.col("__s"), v < F.col("__m") - sigma * F.col("__s")), "average": (v > F.col("__a"), v < F.col("__a")), "extreme": (v > F.col("__q")[1], v < F.col("__q")[0]),
        "sign": (v > 0, v < 0), "change": (F.col("__d") > 0, F.col("__d") < 0), "long_average_change": (F.col("__dl") > 0, F.col("__dl") < 0), "average_change": (F.col("__da") > 0, F.col("__da") < 0),
    }
    found = F.array(*[F.struct(F.lit(k).alias("rule"), F.when(sides[k][0], 1).when(sides[k][1], -1).otherwise(0).alias("signal")) for k in RULES])
    return rows.withColumn("__r", F.explode(found)).select(*df.columns, "__r.*")


def rule_tests(signals: DataFrame, forward: str, ratio: float = 0.7, code: str = "code", date: str = "date") -> DataFrame:
    """(code, rule, n_up, n_down, hit, hit_in, hit_out, payoff_up, payoff_down, welch_t, p_value) of each rule's signals
    against the return that follows; in and out of the first `ratio` of a code's rows with a return."""
    there = split(signals.where(F.col(forward).isNotNull()).withColumn("__k", F.struct(code, "rule")), ratio, "__k", date)
    r, up, down = F.col(forward), F.col("signal") == 1, F.col("signal") == -1
    right = (up & (r > 0)) | (down & (r < 0))
    hit = lambda part: _zero(F.try_divide(F.count_if(right & part), F.count_if((up | down) & part)))
    payoff = lambda side, win: _zero(F.try_divide(F.abs(_zero(F.avg(F.when(side & win, r)))), F.abs(F.coalesce(F.avg(F.when(side & ~win, r)), F.lit(1e-9)))))
    a = there.groupBy(code, "rule").agg(
        F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), hit(F.lit(True)).alias("hit"), hit(F.col("sample") == "in").alias("hit_in"), hit(F.col("sample") == "out").alias("hit_out"),
        payoff(up, r > 0).alias("payoff_up"), payoff(down, r < 0).alias("payoff_down"), F.avg(F.when(up, r)).alias("__mu"), F.avg(F.when(down, r)).alias("__md"), F.var_samp(F.when(up, r)).alias("__vu"), F.var_samp(F.when(down, r)).alias("__vd"),
    )
    eu, ed = F.try_divide("__vu", "n_up"), F.try_divide("__vd", "n_down")
    t = F.when((F.col("n_up") > 1) & (F.col("n_down") > 1), F.try_divide(F.col("__mu") - F.col("__md"), F.nullif(F.sqrt(eu + ed), F.lit(0.0))))
    freedom = F.try_divide((eu + ed) * (eu + ed), eu * eu / (F.col("n_up") - 1) + ed * ed / (F.col("n_down") - 1))
    tested = a.withColumns({"welch_t": t, "__f": F.when(t.isNotNull(), freedom)})
    return tested.withColumn("p_value", t_p_value(F.col("welch_t"), F.col("__f"))).drop("__mu", "__md", "__vu", "__vd", "__f")


def signal_measures(df: DataFrame, signal: str, ret: str, keys: tuple[str, ...] = ("code",), year: float = 252.0, date: str = "date") -> DataFrame:
    """The back-test of a signal held from the next bar on, beside always being in: total, annual, volatility, Sharpe, drawdown,
    Calmar, hit rate, trades, their hit rate and payoff, share of bars held, and the excess over the return itself.

    A trade lasts from one change of position to the next, both bars included; the last one is still open and left out."""
    w = Window.partitionBy(*keys).orderBy(date)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"__p": F.coalesce(F.lag(signal).over(w), F.lit(0)), "__b": _zero(ret)})
    rows = rows.withColumn("__r", F.col("__p") * F.col("__b")).withColumn("__c", (F.col("__p") != F.coalesce(F.lag("__p").over(w), F.col("__p"))).cast("int"))
    rows = rows.withColumns({"__nav": F.exp(F.sum(F.log1p(F.greatest("__r", F.lit(-0.999999)))).over(up_to)), "__seg": F.sum("__c").over(up_to)})
    rows = rows.withColumn("__fall", F.col("__nav") / F.max("__nav").over(up_to) - 1)
    trade = rows.groupBy(*keys, "__seg").agg(F.sum("__r").alias("__t"), F.min_by("__r", date).alias("__first"))
    by_seg = Window.partitionBy(*keys).orderBy("__seg")
    closed = trade.withColumn("__t", F.col("__t") + F.lead("__first").over(by_seg)).where((F.col("__seg") > 0) & F.col("__t").isNotNull())
    t = F.col("__t")
    won, lost = F.avg(F.when(t > 0, t)), F.avg(F.when(t <= 0, t))
    trades = closed.groupBy(*keys).agg(F.avg((t > 0).cast("double")).alias("__tw"), _zero(F.try_divide(won, F.nullif(F.abs(lost), F.lit(0.0)))).alias("__po"))
    r, e = F.col("__r"), F.col("__r") - F.col("__b")
    a = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max_by("__nav", date) / F.min_by("__nav", date) - 1).alias("total"), (F.avg(r) * year).alias("annual"), (F.stddev_samp(r) * year**0.5).alias("volatility"), F.min("__fall").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit"), F.sum("__c").alias("trades"), F.avg((F.col("__p") != 0).cast("double")).alias("held"), (F.avg(e) * year).alias("excess"), (F.stddev_samp(e) * year**0.5).alias("__ev"), F.avg((e > 0).cast("double")).alias("excess_hit"),
    )
    ratio = lambda x, y: _zero(F.try_divide(x, F.nullif(y, F.lit(0.0))))
    return a.join(trades, list(keys), "left").select(
        *keys, "n", "total", "annual", "volatility", ratio("annual", F.col("volatility")).alias("sharpe"), "max_drawdown", ratio("annual", -F.col("max_drawdown")).alias("calmar"), "hit", "trades",
        _zero("__tw").alias("trade_hit"), _zero("__po").alias("payoff"), "held", "excess", ratio("excess", F.col("__ev")).alias("excess_sharpe"), "excess_hit",
    )


def best_rules(tests: DataFrame, code: str = "code") -> DataFrame:
    """(code, rule, hit) of the rule that is right most often; ties go to the first of RULES."""
    place = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    return tests.groupBy(code).agg(F.max_by("rule", F.struct(F.round("hit", 10), -place)).alias("rule"), F.max("hit").alias("hit"))


def report(df: DataFrame, x: str, ret: str, ahead: int, window: int, long_window: int, ic_window: int, ratio: float = 0.7, year: float = 252.0, code: str = "code", date: str = "date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tests, measures, scores) of every code's factor x: all rules' tests; the best rule's back-test; the score's parts."""
    nexts = Window.partitionBy(code).orderBy(date).rowsBetween(1, ahead)
    rows = standardized(df.select(code, date, x, ret).withColumn("forward", F.when(F.count(ret).over(nexts) == ahead, F.sum(ret).over(nexts))), x, code)
    signals = seven_rules(rows, x, window, long_window, code=code, date=date)
    tests = rule_tests(signals, "forward", ratio, code, date)
    best = best_rules(tests, code)
    measures = signal_measures(signals.join(best.select(code, "rule"), [code, "rule"], "left_semi"), "signal", ret, (code, "rule"), year, date)
    ic = split(timing_ic(rows, x, ret, ahead, ic_window, code, date), ratio, code, date)
    fitted = regression(rows, "forward", x, [code])
    fitted = fitted.select(code, "r2", t_p_value(F.col("t"), F.col("n") - 2).alias("p_value"))
    joined = best.join(ic_summary(ic, (code,)).select(code, "icir", "hit_rate"), code, "left").join(fitted, code, "left").join(robustness(ic, code).select(code, "mean_in", "mean_out", "decay"), code, "left")
    return tests, measures, graded(joined)
