"""The score of a timing factor: its parts, their weights, and the grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of the score and their weights, the levels of |ICIR|, the grades.
WEIGHTS = {"part_ic": 0.30, "part_signal": 0.25, "part_regression": 0.20, "part_robust": 0.25}
LEVELS = ((2.0, 0.9), (1.0, 0.7), (0.5, 0.5))
GRADES = ((0.8, "A"), (0.6, "B"), (0.4, "C"), (0.2, "D"))


def _zero(c: Column | str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0.0))


def graded(parts: DataFrame) -> DataFrame:
    """Adds score and grade to rows with icir, hit_rate, hit, r2, p_value, mean_in, mean_out, decay."""
    size = F.abs(_zero("icir"))
    level = F.greatest(F.lit(0.1), size / 2)
    for edge, value in LEVELS[::-1]:
        level = F.when(size >= edge, value).otherwise(level)
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    agree = F.when(F.signum("mean_in") == F.signum("mean_out"), 0.5).otherwise(0.0)
    scored = parts.withColumns({
        "part_ic": level * 0.7 + F.least(F.coalesce("hit_rate", F.lit(0.5)), F.lit(1.0)) * 0.3, "part_signal": unit((_zero("hit") - 0.3) / 0.4), "part_regression": unit(_zero("r2") * 10) * 0.5 + F.when(F.col("p_value") < 0.05, 0.5).otherwise(0.0),
        "part_robust": F.when(F.col("mean_in").isNull() | F.col("mean_out").isNull(), 0.1).otherwise(agree + _zero(F.greatest(F.lit(0.0), 0.5 - F.least("decay", F.lit(1.0)) * 0.5))),
    })
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    grade = F.lit("F")
    for edge, name in GRADES[::-1]:
        grade = F.when(F.round("score", 9) >= edge, name).otherwise(grade)
    return scored.withColumn("score", total).withColumn("grade", grade)
