"""Groups of neighbouring rows: gaps, runs of days, merged intervals, albums, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_sessions(df: DataFrame, by: str, start: Column, end: Column, order: list[str], gap_us: int) -> DataFrame:
    """Rows with ``session``: a new one begins when a row starts more than the gap after the greatest end so far."""
    w = Window.partitionBy(by).orderBy(*order)
    d = df.withColumn("__s", F.unix_micros(start.cast("timestamp"))).withColumn("__e", F.unix_micros(end.cast("timestamp")))
    reach = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__new", F.when(F.col("__s") - reach <= gap_us, 0).otherwise(1))
    return d.withColumn("session", F.sum("__new").over(w)).drop("__s", "__e", "__new")


def albums(df: DataFrame, chat: str, number: str, ts: str, text: str, seconds: int = 10) -> DataFrame:
    """Rows with ``head``: a row without text joins the row right before it if the numbers follow on and the times are near."""
    w = Window.partitionBy(chat).orderBy(number)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    joins = (F.trim(F.coalesce(F.col(text), F.lit(""))) == "") & (F.lag(number).over(w) == F.col(number) - 1) & (F.abs(us - F.lag(us).over(w)) <= seconds * 1_000_000)
    d = df.withColumn("__h", F.when(F.coalesce(joins, F.lit(False)), None).otherwise(F.col(number)))
    return d.withColumn("head", F.last("__h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__h")


def day_streaks(df: DataFrame, by: str, day: Column) -> DataFrame:
    """by, last_day, streak: the run of consecutive days that ends at the latest day."""
    days = df.select(by, day.alias("day")).where("day is not null").distinct()
    w = Window.partitionBy(by).orderBy(F.desc("day"))
    d = days.withColumn("n", F.row_number().over(w)).withColumn("last_day", F.max("day").over(Window.partitionBy(by)))
    return d.where(F.date_add("last_day", 1 - F.col("n")) == F.col("day")).groupBy(by).agg(F.max("day").alias("last_day"), F.count("*").alias("streak"))


def budget_chunks(df: DataFrame, by: str, order: str, ts: str, length: Column, budget: int, gap_minutes: int = 10, hard: float = 1.5) -> DataFrame:
    """Rows with ``chunk``: closed at the first gap once the budget is reached, or anywhere from ``hard`` times it.

    The count of characters restarts with each chunk, which no window can say: one sorted pass a partition,
    holding three numbers.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())])
    gap = gap_minutes * 60_000_000
    d = df.withColumn("__len", length.cast("long")).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, before, no = None, 0, 0, 0
        for b in batches:
            out = []
            for k, n, u in zip(b[by], b["__len"], b["__us"]):
                if k != key:
                    key, used, no = k, 0, 0
                elif used >= hard * budget or (used >= budget and u - before >= gap):
                    used, no = 0, no + 1
                used, before = used + n + 1, u
                out.append(no)
            b["chunk"] = out
            yield b.drop(columns=["__len", "__us"])

    return d.repartition(by).sortWithinPartitions(by, ts, order).mapInPandas(run, schema)
