"""Least squares on several regressors for many groups at once, tests of means, and cross-sectional regressions.

A group's normal equations are centred sums of products, gathered by Spark's own stable covariances; only these
(k + 1)(k + 2) / 2 numbers of a group reach the solver, a batch of groups at a time. The number of groups, and of rows
in a group, is not bounded by any task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from panelyard.functions.distributions import f_p_value, t_p_value

_LIST = ArrayType(DoubleType())
#: Regressors whose correlation matrix has a smaller eigenvalue than this count as dependent: the group has no fit.
DEPENDENT = 1e-10


@pandas_udf(StructType([StructField("beta", _LIST), StructField("se", _LIST), StructField("r2", DoubleType())]))
def _solved(n: pd.Series, means: pd.Series, products: pd.Series) -> pd.DataFrame:
    """Coefficients (the constant first) and their errors. means: of y and the regressors; products: mean products of
    what is left of them, row by row of the upper triangle."""
    out = pd.DataFrame({c: pd.Series([None] * len(n), dtype=object) for c in ("beta", "se")} | {"r2": np.full(len(n), np.nan)})
    if not len(n):
        return out
    count, mean, k = n.to_numpy(float), np.stack(means.to_list()).astype(float), len(means.iloc[0]) - 1
    gram = np.zeros((len(n), k + 1, k + 1))
    row, column = np.triu_indices(k + 1)
    gram[:, row, column] = gram[:, column, row] = np.stack(products.to_list()).astype(float) * count[:, None]
    scale = np.sqrt(np.maximum(np.einsum("gii->gi", gram)[:, 1:], 0))
    live = np.flatnonzero(np.isfinite(gram).all(axis=(1, 2)) & (scale > 0).all(axis=1) & (count > k + 1))
    outer = scale[live, :, None] * scale[live, None, :]
    live = live[np.linalg.eigvalsh(gram[live, 1:, 1:] / outer)[:, 0] > DEPENDENT]
    if not len(live):
        return out
    count, mean, gram, outer = count[live], mean[live], gram[live], scale[live, :, None] * scale[live, None, :]
    inverse, cross, at = np.linalg.inv(gram[:, 1:, 1:] / outer) / outer, gram[:, 1:, 0], mean[:, 1:]
    slope = np.einsum("gij,gj->gi", inverse, cross)
    left = np.maximum(gram[:, 0, 0] - (slope * cross).sum(axis=1), 0.0)
    error = left / (count - k - 1)
    spread = np.c_[1 / count + np.einsum("gi,gij,gj->g", at, inverse, at), np.einsum("gii->gi", inverse)]
    r2 = np.divide(left, gram[:, 0, 0], out=np.full(len(live), np.nan), where=gram[:, 0, 0] > 0)
    for name, values in (("beta", np.c_[mean[:, 0] - (at * slope).sum(axis=1), slope]), ("se", np.sqrt(error[:, None] * spread))):
        out.loc[live, name] = pd.Series(list(values), index=live, dtype=object)
    out.loc[live, "r2"] = 1 - r2
    return out


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], least: int = 0) -> DataFrame:
    """(by, n, beta, se, t, r2, adj_r2, f): y on a constant and xs, by group; arrays have the constant first.

    Rows need all values. Groups of fewer rows than `least`, or of dependent regressors, have no row."""
    names = [y, *xs]
    both = df.select(*by, *(F.col(c).cast("double").alias(c) for c in names)).where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    grams = both.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("__m"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("__p"))
    fit = grams.where(F.col("n") >= max(least, len(names) + 1)).withColumn("__s", _solved(F.col("n").cast("double"), "__m", "__p")).where("__s.beta IS NOT NULL")
    k, r2 = len(xs), F.col("__s.r2")
    ratio = F.zip_with("__s.beta", "__s.se", lambda b, s: F.try_divide(b, F.nullif(s, F.lit(0.0))))
    return fit.select(
        *by, "n", F.col("__s.beta").alias("beta"), F.col("__s.se").alias("se"), ratio.alias("t"), r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - k - 1)).alias("adj_r2"),
        F.try_divide(r2 * (F.col("n") - k - 1), (1 - r2) * k).alias("f"),
    )


def terms(fit: DataFrame, xs: Sequence[str], by: Sequence[str], constant: str = "const") -> DataFrame:
    """One row for each coefficient of each group: (by, term, beta, se, t, p_value)."""
    names = F.array(*[F.lit(x) for x in (constant, *xs)])
    long = fit.select(*by, "n", F.explode(F.arrays_zip(names.alias("term"), "beta", "se", "t")).alias("c")).select(*by, "n", "c.*")
    return long.withColumn("p_value", t_p_value(F.col("t"), F.col("n") - len(xs) - 1)).drop("n")


def fit_p_value(fit: DataFrame, k: int) -> DataFrame:
    """Adds the p value of F with k regressors."""
    return fit.withColumn("f_p_value", f_p_value(F.col("f"), F.lit(k), F.col("n") - k - 1))


def residuals(df: DataFrame, fit: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], name: str = "residual") -> DataFrame:
    """Rows with what their group's fit leaves of y; rows without a fit or a value have NULL."""
    guess = F.col("__b")[0]
    for i, x in enumerate(xs, 1):
        guess = guess + F.col("__b")[i] * F.col(x)
    return df.join(fit.select(*by, F.col("beta").alias("__b")), list(by), "left").withColumn(name, F.col(y) - guess).drop("__b")


def t_test(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, std, t, p_value): whether the mean of x differs from 0."""
    a = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    tested = a.withColumn("t", F.try_divide("mean", F.nullif("std", F.lit(0.0))) * F.sqrt("n"))
    return tested.withColumn("p_value", t_p_value(F.col("t"), F.col("n") - 1))


def within(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The columns less their means by group: what group dummies leave of them."""
    cell = Window.partitionBy(*by)
    return df.withColumns({c: F.col(c) - F.avg(c).over(cell) for c in columns})


def fama_macbeth(df: DataFrame, y: str, xs: Sequence[str], group: str | None = None, date: str = "date") -> DataFrame:
    """(factor, n, mean, std, t, p_value) of the slopes of each date's regression of y on xs, with dummies of `group`.

    Dates need k + 5 rows. Dummies take their group's means away from all sides, so slopes are those with dummies; a row
    without a group has all dummies 0, as a group of its own."""
    usable = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs])).withColumn("__n", F.count("*").over(Window.partitionBy(date))).where(F.col("__n") >= len(xs) + 5)
    if group:
        usable = within(usable.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit(""))), [y, *xs], [date, "__g"])
    slopes = ols(usable, y, xs, [date]).select(date, F.explode(F.arrays_zip(F.array(*map(F.lit, xs)).alias("factor"), F.slice("beta", 2, len(xs)).alias("slope"))).alias("c")).select("c.*")
    return t_test(slopes, "slope", ["factor"])


def one_regressor(tested: DataFrame) -> DataFrame:
    """p values of beta and of the whole for rows of n, t and f of one regressor."""
    lost: Column = F.col("n") - 2
    return tested.withColumns({"p_value": t_p_value(F.col("t"), lost), "f_p_value": f_p_value(F.col("f"), F.lit(1), lost)})
