"""Bootstrap tests of factors: resampled rows, the largest t over factors, what a factor adds to those accepted, and
whether a fund's constant is more than luck. Draws are digests, so any engine and any partitioning makes the same ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.regression import ols


def t_value(y: str, x: str) -> Column:
    """The t value of the slope of y on x over a group."""
    n, r = F.count("*"), F.when(F.stddev_pop(x) * F.stddev_pop(y) > 1e-15, F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))
    return F.try_divide(r * F.sqrt(n - 2), F.nullif(F.sqrt(1 - r * r), F.lit(0.0)))


def drawn(seed: int, rows: Column, *of: Column | str) -> Column:
    """A place below `rows`, from the first 32 bits of a digest of the seed and `of`."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), rows.cast("long")).cast("int")


def draws(rows: int, replicates: DataFrame, seed: int) -> DataFrame:
    """(replicate, place): `rows` places with replacement for each replicate."""
    slots = replicates.select("replicate", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("slot"))
    return slots.select("replicate", drawn(seed, F.lit(rows), "replicate", "slot").alias("place"))


def max_t_test(long: DataFrame, replicates: int = 200, seed: int = 1, date: str = "date") -> DataFrame:
    """(factor, t, p_value): p is the share of replicates whose largest t over all factors is, without its sign, at least
    the factor's own. long: date, factor, x, y; a date is resampled with all its factors."""
    tested = long.groupBy("factor").agg(t_value("y", "x").alias("t"))
    numbered = long.select(date).distinct().withColumn("place", F.row_number().over(Window.orderBy(date)) - 1)  # a calendar
    n = numbered.count()
    flat = long.join(numbered, date).select("place", "factor", "x", "y")
    picks = draws(n, long.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")), seed)
    largest = picks.join(flat, "place").groupBy("replicate", "factor").agg(t_value("y", "x").alias("t")).groupBy("replicate").agg(F.abs(F.max("t")).alias("__m"))
    edge = largest.agg(F.sort_array(F.collect_list("__m")).alias("__all"))  # one number a replicate
    return tested.join(F.broadcast(edge)).select("factor", "t", (F.size(F.filter("__all", lambda v: v >= F.abs("t"))) / F.size("__all")).alias("p_value"))


def orthogonalized(df: DataFrame, factors: Sequence[str], accepted: Sequence[str] = ()) -> DataFrame:
    """The factors made free of a level: less their means, or, once factors are accepted, less the constant of their
    regression on those. One job for the constants (one number a factor)."""
    if accepted:
        fits = [ols(df, f, accepted, []).select(F.lit(f).alias("factor"), F.col("beta")[0].alias("c")) for f in factors]
        level = {r.factor: r.c for part in fits for r in part.collect()}
    else:
        level = df.agg(*[F.avg(f).alias(f) for f in factors]).first().asDict()
    return df.withColumns({f: F.col(f) - F.lit(level.get(f) or 0.0) for f in factors})


def long_form(df: DataFrame, y: str, factors: Sequence[str], date: str = "date") -> DataFrame:
    parts = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])
    return df.select(date, F.explode(parts).alias("p"), F.col(y).alias("y")).select(date, "p.*", "y")


def incremental_test(df: DataFrame, y: str, factors: Sequence[str], replicates: int = 200, seed: int = 1, level: float = 0.1, least: int = 100, date: str = "date") -> DataFrame:
    """(round, factor, abs_t, p_value, significant): factors are accepted at p below `level`; y goes on as what they leave
    of it, one after the other; the others are tested again, until all or none of a round are accepted. The last round's
    rows are the verdict on the factors that were left. Fewer than `least` whole rows: no rows.

    The driver steers: a round is one job over the rows and its results are one row a factor."""
    spark = df.sparkSession
    rows = df.select(date, F.col(y).cast("double").alias("__y"), *(F.col(f).cast("double").alias(f) for f in factors)).dropna()
    out, left, accepted = [], list(factors), []
    enough = rows.count() >= least
    while enough and left:
        turned = orthogonalized(rows, left, accepted)
        found = {r.factor: r for r in max_t_test(long_form(turned, "__y", left, date), replicates, seed, date).collect()}
        number = 1 + (out[-1][0] if out else 0)
        out += [(number, f, abs(found[f].t) if found[f].t is not None else None, found[f].p_value, found[f].p_value is not None and found[f].p_value < level) for f in left]
        won = [f for f in left if out[-len(left) + left.index(f)][4]]
        if not won or len(won) == len(left):
            break
        for f in won:
            fit = ols(rows, "__y", [f], []).select("beta").first()
            if fit:
                rows = rows.withColumn("__y", F.col("__y") - F.lit(fit.beta[0]) - F.lit(fit.beta[1]) * F.col(f))
        accepted += won
        left = [f for f in left if f not in won]
    return spark.createDataFrame(out, "round int, factor string, abs_t double, p_value double, significant boolean")


def alpha_test(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], replicates: int = 200, seed: int = 1, least: int = 30, date: str = "date") -> DataFrame:
    """(by, n, alpha, alpha_t, alpha_p): the t value of each fund's constant against those of funds that have its slopes
    and its residuals, but no constant. A replicate draws rows, factors and residuals together, and is fitted again; p is
    the share of replicates whose constant has a t at least as large, without signs.

    by: what a fund is, and a window if there are several; rows are drawn within it, in order of `date`."""
    keys = list(by)
    whole = df.select(*keys, date, F.col(y).cast("double").alias("__y"), *(F.col(x).cast("double").alias(x) for x in xs)).dropna(subset=["__y", *xs])
    fit = ols(whole, "__y", xs, keys, least)
    explained = sum((F.col("__b")[i] * F.col(x) for i, x in enumerate(xs, 1)), F.lit(0.0))
    own = Window.partitionBy(*keys)
    rows = whole.join(fit.select(*keys, F.col("n").alias("__n"), F.col("beta").alias("__b")), keys).withColumn("__fake", F.col("__y") - F.col("__b")[0])
    rows = rows.withColumn("__left", F.col("__fake") - explained).withColumn("__place", F.row_number().over(own.orderBy(date)) - 1)
    # a fund without its constant is its slopes' part and its residual, and both are drawn together; a fund's rows are an
    # array, so that its draws are taken where it lies
    held = rows.groupBy(*keys, "__n").agg(F.array_sort(F.collect_list(F.struct("__place", (explained + F.col("__left")).alias("__fake"), *xs))).alias("__rows"))
    each = held.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    slots = F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))
    sampled = each.select(*keys, "replicate", F.inline(F.transform(slots, lambda slot: F.get("__rows", drawn(seed, F.col("__n"), "replicate", slot)))))
    fakes = ols(sampled, "__fake", xs, [*keys, "replicate"]).select(*keys, F.abs(F.col("t")[0]).alias("__t"))
    real = fit.select(*keys, "n", F.col("beta")[0].alias("alpha"), F.col("t")[0].alias("alpha_t"))
    judged = fakes.join(real, keys).groupBy(*keys).agg(F.avg((F.col("__t") >= F.abs("alpha_t")).cast("double")).alias("alpha_p"))
    return real.join(judged, keys, "left")


def segments(df: DataFrame, spans: Sequence[tuple[str, str, str]], date: str = "date") -> DataFrame:
    """Rows with the label of each segment (label, first date, last date, both within) that has them; a row may be in
    several segments."""
    listed = F.array(*[F.struct(F.lit(label).alias("label"), F.to_date(F.lit(a)).alias("a"), F.to_date(F.lit(b)).alias("b")) for label, a, b in spans])
    inside = F.filter(listed, lambda s: (F.col(date).cast("date") >= s["a"]) & (F.col(date).cast("date") <= s["b"]))
    return df.withColumn("__s", F.explode(inside)).withColumn("segment", F.col("__s.label")).drop("__s")
