"""Queries of the formula catalog, over monthly bars, or weekly ones for formulas that look back far."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import catalog
from panelyard.functions import formula as engine
from panelyard.functions.formula import X, formula_sql, with_formula
from panelyard.sources.panel import panel, panel_sql

LONG = 50


def rounded(x: Column) -> Column:
    """Both engines sum in their own order: 6 digits, shifted off the ties of rational values; 2 for large values, and 7
    digits in all for huge ones."""
    large = F.when(F.abs(x) < 1e9, engine.rounded(x + 3.7e-5, 2)).otherwise(F.format_string("%.6e", x.cast("double")).try_cast("double"))
    return F.when(F.abs(x) < 1000, engine.rounded(x + 3.7e-9, 6)).otherwise(large)


def rounded_sql(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1000 THEN round({x} + 3.7e-9, 6) WHEN abs({x}) < 1e9 THEN round({x} + 3.7e-5, 2) ELSE CAST(format('{{:.6e}}', CAST({x} AS DOUBLE)) AS DOUBLE) END)"


def bar_of(formula: X) -> str:
    return "week" if catalog.history(formula) > LONG else "month"


def run(formula: X, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_formula(panel(spark, sf_dir, bar_of(formula)), formula)
    return found.select("code", "date", rounded(F.col("factor")).alias("factor"))


def sql(formula: X) -> str:
    return formula_sql(panel_sql(bar_of(formula)), formula, "code, date, " + rounded_sql("{factor}").replace("{:.6e}", "{{:.6e}}") + " AS factor")


NAMED: dict[str, X] = {f"alpha_{n:03d}": f for n, f in catalog.FORMULAS.items()} | {f"factor_{k}": f for k, f in catalog.OTHERS.items()}
QUERIES = {name: partial(run, f) for name, f in NAMED.items()}
ORACLE_SQL = {name: sql(f) for name, f in NAMED.items()}
