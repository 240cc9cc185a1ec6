"""Sinks that can be repeated: a table kept by partitions, of which a run writes only those that it computed anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.sources.history import changed_days


def replace_partitions(df: DataFrame, path: str, by: list[str], rows: int = 1_000_000) -> None:
    """Writes df as Parquet; partitions that it has rows of are replaced, all others stay. Running it twice changes nothing.

    Rows of a partition go to few files: they are dealt by the partition's values, and files end after `rows` rows."""
    dealt = df.repartition(*by).sortWithinPartitions(*by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows).partitionBy(*by).parquet(path)


def write_changed(spark: SparkSession, df: DataFrame, path: str, keys: list[str], part: Column, name: str, first: bool = False) -> DataFrame:
    """Writes df by `part` (a column of it, as `name`), but only the partitions that differ from what is stored; returns
    the partitions that were written."""
    new = df.withColumn(name, part)
    if first:
        replace_partitions(new, path, [name])
        return new.select(name).distinct()
    old = spark.read.parquet(path).withColumn(name, F.col(name).cast(new.schema[name].dataType)).select(*new.columns)
    values = [r[0] for r in changed_days(old, new, [*keys, name], name).collect()]  # one value a partition
    if values:
        replace_partitions(new.where(F.col(name).isin(values)), path, [name])
    return spark.createDataFrame([(v,) for v in values], f"{name} {new.schema[name].dataType.simpleString()}")


def write_table(df: DataFrame, path: str, order: list[str], kind: str = "csv") -> None:
    """A small result table (a sweep, a report) as one ordered file, CSV with a header or Parquet."""
    one = df.orderBy(*order).coalesce(1).write.mode("overwrite")
    one.option("header", True).csv(path) if kind == "csv" else one.parquet(path)
