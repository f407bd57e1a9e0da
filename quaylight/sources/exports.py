"""Chat exports in markdown, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The line shapes of the two kinds of export.
TAGGED = r"^\[Telegram / (.+?) / (\d{2}:\d{2}) / (.+?)\] (.*)$"
HEADER = r"^### \d{4}-\d{2}-\d{2} (\d{2}:\d{2})$"
SPOKEN = r"^\*\*([^*]+)\*\*:\s*(.*)$"
IMAGE = r"\[(图片|视频|文件|语音)\]\s*local_id=(\d+)"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: source (file name without ending), text."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("source"), F.col("value").alias("text"))


def lines(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the text, with line_no and line (trimmed)."""
    return df.select("*", F.posexplode(F.split(F.col(text), r"\r\n|[\n\r]")).alias("line_no", "__l")).withColumn("line", F.trim("__l")).drop("__l", text)


def tagged_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Messages of lines that carry group, time and sender themselves: key, line_no, group_name, time, sender, message."""
    part = lambda i: F.trim(F.regexp_extract("line", TAGGED, i))
    rows = lines(df.select(key, text), text).where(F.col("line").rlike(TAGGED))
    return rows.select(key, "line_no", part(1).alias("group_name"), part(2).alias("time"), part(3).alias("sender"), part(4).alias("message")).where("message <> ''")


def headed_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Messages under time headers; a header's time holds until the next one: key, line_no, time, sender, message."""
    rows = lines(df.select(key, text), text).where(F.col("line").rlike(HEADER) | F.col("line").rlike(SPOKEN))
    time = F.when(F.col("line").rlike(HEADER), F.regexp_extract("line", HEADER, 1))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("time", F.coalesce(F.last(time, ignorenulls=True).over(w), F.lit("")))
    part = lambda i: F.trim(F.regexp_extract("line", SPOKEN, i))
    return rows.where(F.col("line").rlike(SPOKEN)).select(key, "line_no", "time", part(1).alias("sender"), part(2).alias("message")).where("message <> ''")


def media_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Attachments named in the messages: key, line_no, time, sender, media_type, media_id."""
    m = headed_messages(df, key, text)
    found = F.explode(F.arrays_zip(F.regexp_extract_all("message", F.lit(IMAGE), F.lit(1)), F.regexp_extract_all("message", F.lit(IMAGE), F.lit(2))))
    return m.select(key, "line_no", "time", "sender", found.alias("f")).select(key, "line_no", "time", "sender", F.col("f.0").alias("media_type"), F.col("f.1").cast("bigint").alias("media_id"))


def rendered(group: Column, time: Column, sender: Column, text: Column, forwarded: Column | None = None) -> Column:
    """One tagged line."""
    head = F.concat(F.lit("[Telegram / "), group, F.lit(" / "), time, F.lit(" / "), F.coalesce(sender, F.lit("unknown")), F.lit("]"))
    mark = F.when(forwarded, " [转发]").otherwise("") if forwarded is not None else F.lit("")
    return F.concat(head, mark, F.lit(" "), F.trim(text))
