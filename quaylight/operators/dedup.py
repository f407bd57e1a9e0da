"""First, last and rolling-window ownership of keys.

A hot key is folded by partial aggregation before the shuffle, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.functions.batches import whole_groups


def first_owner(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first in ``order`` of its rows, with ``copies``."""
    rest = [c for c in df.columns if c != key]
    got = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"), F.count("*").alias("copies"))
    return got.select(key, "__r.*", "copies")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def finalized(df: DataFrame, key: str, order: str, published: str, cap: int) -> DataFrame:
    """First of each key, newest first with unknown times last, at most ``cap``."""
    return first_owner(df, key, [order]).drop("copies").orderBy(F.desc_nulls_last(published), order).limit(cap)


def rolling_owners(df: DataFrame, key: str, ts: str, tie: str, days: float) -> DataFrame:
    """Every row with ``owner``: the tie value of the accepted row whose window of ``days`` it falls in, itself if it is accepted.

    A window opens at an accepted row and is not prolonged by the rows in it, so the state
    is the last accepted row alone: one sorted pass holding one value a key, however
    many rows the key has.  Between accepted rows further apart than the window nothing is shared, so a
    hot key's rows are first cut at such gaps and the pieces spread over tasks.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(ts, tie)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = int(days * 86_400_000_000)
    gap = F.when(us - F.lag(us).over(w) <= span, 0).otherwise(1)
    cut = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__us", us).withColumn("__gap", gap)
    cut = cut.withColumn("__piece", F.sum("__gap").over(w)).drop("__gap")
    schema = T.StructType([*df.schema.fields, T.StructField("owner", df.schema[tie].dataType)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        opened, owner = 0, None
        for b in batches:
            out = []
            for k, p, u, t in zip(b[key], b["__piece"], b["__us"], b[tie]):
                if (k, p) != last or u - opened >= span:
                    last, opened, owner = (k, p), u, t
                out.append(owner)
            b["owner"] = out
            yield b.drop(columns=["__us", "__piece"])

    return cut.repartition(key, "__piece").sortWithinPartitions(key, "__piece", ts, tie).mapInPandas(run, schema)


def greedy_intervals(df: DataFrame, group: str, start: str, end: str, order: str, least: float = 0.5) -> DataFrame:
    """Rows kept when taken in ``order``: those that overlap no kept row of their group by ``least`` of the narrower.

    Only rows that overlap anything are decided one by one; they form runs of
    touching intervals, and runs are independent, so a group is spread over its runs.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(start, end, order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(w)).drop("__new")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, [group, "__run"]):
            keep = []
            for _, g in pdf.groupby([group, "__run"], sort=False, dropna=False):
                kept: list[tuple[int, int]] = []
                for i, s, e in sorted(zip(g.index, g[start], g[end]), key=lambda x: g.at[x[0], order]):
                    if all(max(0, min(e, f) - max(s, t) + 1) < least * min(e - s + 1, f - t + 1) for t, f in kept):
                        kept.append((s, e))
                        keep.append(i)
            yield pdf.loc[sorted(keep)].drop(columns="__run")

    return d.repartition(group, "__run").sortWithinPartitions(group, "__run").mapInPandas(run, df.schema)
