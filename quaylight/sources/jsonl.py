"""Append-only logs of one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the good lines, with ``line_no`` rising in the order of the file name and the lines in it, and ``file``."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line_no"))
    got = raw.select("file", "line_no", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), F.try_parse_json("value").alias("v"))
    return got.where("v is not null and r is not null").select("r.*", "line_no", "file")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines, bad: how many there are and how many aren't JSON; blank lines don't count."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.agg(F.count("*").alias("lines"), F.count_if(F.try_parse_json("value").isNull()).alias("bad"))


def append_lines(df: DataFrame, path: str, required: list[str]) -> None:
    """Append the rows that have all required values."""
    cond = F.lit(True)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    df.where(cond).write.mode("append").json(path)


def fresh_index(spark: SparkSession, path: str, now: str, ttl_days: int = 14, max_age_hours: int = 24) -> DataFrame:
    """Entries of a pushed key map {entries: {key: {ts, by, assumed}}}: none from a stale file, none older than the time to live."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("at"))
    live = raw.where(F.col("at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(max_age_hours)))
    e = live.select(F.explode(F.from_json("value", "entries map<string, struct<ts:string, by:string, assumed:boolean>>")["entries"]).alias("key", "e"))
    ts = F.col("e.ts").try_cast("timestamp")
    return e.select("key", ts.alias("ts"), "e.by", F.coalesce("e.assumed", F.lit(False)).alias("assumed")).where(ts >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(ttl_days)))
