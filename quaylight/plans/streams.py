"""Queries that run as streams over what is there, and give their result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.plans.registry import query
from quaylight.session import fresh_path
from quaylight.sources.tables import table
from quaylight.streaming import forward, windows


def _landed(spark: SparkSession, df: DataFrame, files: int, by: str) -> tuple[str, str]:
    """A folder whose ``files`` parts land one after the other in the order of ``by``, as a source of a stream, and a folder for the run."""
    root = fresh_path(spark, "stream")
    cuts = df.approxQuantile(by, [k / files for k in range(1, files)], 0.01)
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df.where((F.col(by) >= lo) if lo is not None else F.lit(True)).where((F.col(by) < hi) if hi is not None else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    return f"{root}/in", root


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@query("stream_tumbling_counts", """
select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n from events group by 1, 2 having time_bucket(interval 1 day, ts, timestamp '1970-01-01') + interval 1 day <= (select max(ts) from events) - interval 1 hour""")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by type as the watermark closes them."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder, root = _landed(spark, e, 4, "event_id")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = windows.drained(spark, windows.tumbling_counts(src, "ts", ["event_type"], "1 day", "1 hour"), root)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("stream_forwarded_keys", "select fingerprint, min(seq) as seq from content_seen where fingerprint is not null group by 1")
def stream_forwarded_keys(spark: SparkSession, d: str) -> DataFrame:
    """Messages forwarded by a stream that holds back known keys: each key once, by its first message."""
    c = table(spark, d, "content_seen").select("seq", "fingerprint")
    folder, root = _landed(spark, c, 4, "seq")
    sent = forward.forward_files(spark, folder, _schema(c), root, F.col("fingerprint"), ["seq"])
    return sent.where("fingerprint is not null")


@query("stream_throttled_events", """
with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
a as (select event_id, user_id, ts, n from e where n = 1 union all
 select event_id, user_id, ts, n from (select e.*, row_number() over (partition by e.user_id order by e.n) as r from a join e on e.user_id = a.user_id and e.ts >= a.ts + interval 6 hours) where r = 1) select event_id, user_id from a""")
def stream_throttled_events(spark: SparkSession, d: str) -> DataFrame:
    """Events let through when a user may send one in six hours."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    folder, root = _landed(spark, e, 2, "event_id")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return windows.drained(spark, windows.throttled(src, "user_id", "ts", 6 * 3600), root).select("event_id", "user_id")


@query("stream_first_by_user", "select user_id, event_type, count(*) as n from (select distinct user_id, event_type, value from events) group by 1, 2")
def stream_first_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Values of a user and type that a stream hands on once each, counted."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    folder, root = _landed(spark, e, 3, "event_id")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    once = windows.drained(spark, windows.first_within(src, "ts", ["user_id", "event_type", "value"], "400 days"), root)
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
