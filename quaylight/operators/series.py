"""Baselines of daily measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_median(df: DataFrame, by: str, day: str, value: Column, days: int = 28, least: int = 7) -> Column:
    """Median of the positive values of the ``days`` before a day, the day left out; null under ``least`` of them."""
    w = Window.partitionBy(by).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    positive = F.when(value > 0, value)
    return F.when(F.count(positive).over(w) >= least, F.percentile(positive, 0.5).over(w))


def complete_totals(df: DataFrame, keys: list[str], metric: str, metrics: list[str], value: str, complete: Column) -> DataFrame:
    """Sum of each metric a key, null unless every contributing row is complete."""
    d = df.withColumn("__ok", complete)
    aggs = [F.when(F.min(F.when(F.col(metric) == m, F.col("__ok"))), F.sum(F.when(F.col(metric) == m, F.col(value)))).alias(m) for m in metrics]
    return d.groupBy(*keys).agg(*aggs)
