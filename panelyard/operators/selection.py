"""Parameter sweeps: grids, windows, champions, fronts and survivors over tables of evaluated candidates."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, values: dict[str, list], cap: int = 2560) -> DataFrame:
    """(gid, one column a parameter): all combinations, numbered in order; more than `cap` are an error."""
    rows = list(itertools.product(*values.values()))
    if len(rows) > cap:
        raise ValueError(f"{len(rows)} combinations, over {cap}")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["gid", *values])


def rolling_windows(calendar: DataFrame, length: int, step: int, date: str = "date") -> DataFrame:
    """(window, start, end): windows of `length` trading dates, every `step` dates."""
    numbered = calendar.select(date).distinct().withColumn("n", F.row_number().over(Window.orderBy(date)) - 1)
    ends = numbered.select(F.col(date).alias("end"), (F.col("n") - (length - 1)).alias("n"))
    return numbered.where(F.col("n") % step == 0).join(ends, "n").select((F.col("n") / step).cast("int").alias("window"), F.col(date).alias("start"), "end")


def train_test_windows(calendar: DataFrame, train: int, test: int, date: str = "date") -> DataFrame:
    """(window, train_start, train_end, test_start, test_end): contiguous, the test after the training, a test apart."""
    days = calendar.select(date).distinct().withColumn("n", F.row_number().over(Window.orderBy(date)) - 1)
    at = lambda name, k: days.select(F.col(date).alias(name), (F.col("n") - k).alias("n"))
    out = days.where(F.col("n") % test == 0).select("n", F.col(date).alias("train_start"))
    for name, k in (("train_end", train - 1), ("test_start", train), ("test_end", train + test - 1)):
        out = out.join(at(name, k), "n")
    return out.select((F.col("n") / test).cast("int").alias("window"), "train_start", "train_end", "test_start", "test_end")


def champions(df: DataFrame, score: str, gid: str = "gid", by: tuple[str, ...] = ("window",)) -> DataFrame:
    """The best candidate of each window, ties to the smaller id."""
    return df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.max_by(gid, F.struct(score, -F.col(gid))).alias(gid), F.max(score).alias(score))


def wins(best: DataFrame, score: str, gid: str = "gid") -> DataFrame:
    return best.groupBy(gid).agg(F.count("*").alias("wins"), F.avg(score).alias("mean_score"))


def violation(limits: dict[str, tuple[str, float]]) -> Column:
    """How far a candidate breaks its limits, each as a share of the limit: ('min' or 'max', value) by column."""
    parts = [F.greatest(F.lit(0.0), (v - F.col(c)) if kind == "min" else (F.col(c) - v)) / abs(v) for c, (kind, v) in limits.items()]
    return sum(parts[1:], parts[0])


def pareto_front(df: DataFrame, x: str, y: str, parts: int = 64) -> DataFrame:
    """Rows that no other row beats on one measure without losing on the other.

    Ordered by x, then y, downwards, a row is on the front if its y is above all y of larger x, and the best of its x.
    A row off the front of some of the rows is off that of all: fronts of `parts` parts come first, and only they meet."""
    valid = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    steps = valid.groupBy(F.col(x).alias("__x")).agg(F.max(y).alias("__y"))
    for by in ([F.pmod(F.xxhash64("__x"), F.lit(parts))], []):
        larger = Window.partitionBy(*by).orderBy(F.desc("__x")).rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("__above", F.max("__y").over(larger)).where(F.col("__above").isNull() | (F.col("__y") > F.col("__above"))).select("__x", "__y")
    return valid.join(steps.select(F.col("__x").alias(x), F.col("__y").alias(y)), [x, y], "left_semi")


def survivors(df: DataFrame, score: str, reduction: int, least: int, gid: str = "gid", always: tuple = ()) -> DataFrame:
    """The best n / reduction candidates (`least` at least), and those that always go on."""
    total = df.count()
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(score), gid))
    return df.withColumn("place", place).where((F.col("place") <= max(least, total // reduction)) | F.col(gid).isin(*always))


def frequent_winners(counts: DataFrame, percentile: float) -> DataFrame:
    """Candidates whose wins reach a percentile of all candidates' wins."""
    edge = counts.agg(F.percentile("wins", F.lit(percentile)).alias("__e"))
    return counts.join(F.broadcast(edge)).where(F.col("wins") >= F.col("__e")).drop("__e")


def ranks(df: DataFrame, score: str, gid: str = "gid", by: tuple[str, ...] = ("window",)) -> DataFrame:
    """Adds the rank of each candidate of a window by its score; equal scores share the better rank."""
    return df.where(F.col(score).isNotNull()).withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score))))


def selection_table(df: DataFrame, x: str, y: str, broken: Column, gid: str = "gid") -> DataFrame:
    """The front of the feasible candidates (or, if none is, of those that break their limits least), and whether each is
    in the top fifth of the front by x; in order of that, y and id."""
    judged = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("violation", F.round(broken, 12))
    least = judged.agg(F.min("violation").alias("__v"))
    front = pareto_front(judged.join(F.broadcast(least)).where(F.col("violation") <= F.col("__v") + 1e-12).drop("__v"), x, y)
    edge = front.agg(F.percentile(x, F.lit(0.8)).alias("__e"))
    found = front.join(F.broadcast(edge)).withColumn("top", F.col(x) >= F.col("__e")).drop("__e")
    return found.orderBy(F.desc("top"), F.desc(y), gid)


#: By kind of parameter, how its default is varied for a search.
SPREAD = {"window": (0.5, 1.0, 2.0), "lag": (0.5, 1.0, 2.0), "exponent": (0.5, 1.0, 2.0), "weight": (0.5, 1.0, 1.5)}


def candidate_values(kind: str, default: float) -> list[float]:
    """Values to try around a default: windows and lags at least 1 (whole if the default is), weights within 0 and 1,
    thresholds by half their size or 0.05; other kinds keep the default."""
    if kind == "threshold":
        step = max(abs(default) * 0.5, 0.05)
        found = [default - step, default, default + step]
    elif kind in ("window", "lag"):
        found = [max(1, default * k) for k in SPREAD[kind]]
        found = [int(v + 0.5) for v in found] if isinstance(default, int) else found
    elif kind == "weight":
        found = [min(1.0, max(0.0, default * k)) for k in SPREAD[kind]]
        found[1] = default
    else:
        found = [default * k for k in SPREAD[kind]] if kind in SPREAD else [default]
    return list(dict.fromkeys(found))


def search_space(parameters: dict[str, tuple[str, float]], most: int = 3) -> dict[str, list[float]]:
    """Values by parameter (kind, default) for `grid`: the first `most` parameters that have several values are varied."""
    out: dict[str, list[float]] = {}
    for name, (kind, default) in parameters.items():
        values = candidate_values(kind, default)
        varied = sum(len(v) > 1 for v in out.values())
        out[name] = values if len(values) == 1 or varied < most else [default]
    return out
