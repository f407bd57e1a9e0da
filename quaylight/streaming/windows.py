"""Windowed counts, late data, duplicates and throttling in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(stream: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts of tumbling windows; rows later than ``late`` behind the greatest time are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).count().select(F.col("window.start").alias("window_start"), *keys, F.col("count").alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key, closed by a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).count().select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), F.col("count").alias("n"))


def first_within(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def throttled(stream: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows let through: the first of a key, then each at least ``seconds`` after the last one let through.

    Per key the state is one number.  Rows of one batch are taken in time order; a row older than the
    last one let through is held back.
    """
    schema = stream.schema
    span = seconds * 1_000_000

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        keep = []
        for t in rows[ts].astype("datetime64[us]").astype("int64"):
            ok = last is None or t - last >= span
            keep.append(ok)
            last = int(t) if ok else last
        state.update((last,))
        yield rows[keep]

    return stream.groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def drained(spark, stream: DataFrame, work: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a folder, and read the folder."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")
