"""Windowed and incremental reads of message tables, marks and seen keys."""

from __future__ import annotations

from datetime import date, datetime, time, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Shanghai"


def chat_ids(chat: int | str) -> list[int]:
    """The spellings under which one chat is stored: as given, without sign, and without its prefix 100 or, lacking one, with it in both signs."""
    n = int(chat)
    digits = str(abs(n))
    long = int(f"100{digits}")
    return sorted({n, abs(n)} | ({int(digits[3:])} if digits.startswith("100") and len(digits) > 3 else {long, -long}))


def chat_ids_col(chat: Column) -> Column:
    """``chat_ids`` of a column, as a sorted array; null where it is no number."""
    n = chat.cast("string").try_cast("bigint")
    digits = F.abs(n).cast("string")
    long = F.concat(F.lit("100"), digits).try_cast("bigint")
    other = F.when(digits.rlike("^100."), F.array(F.substring(digits, 4, 20).try_cast("bigint"))).otherwise(F.array(long, -long))
    return F.when(n.isNotNull(), F.array_sort(F.array_distinct(F.concat(F.array(n, F.abs(n)), other))))


def day_window(df: DataFrame, ts: str, since: str, until: str, zone: str = LOCAL_ZONE) -> Column:
    """ts in [since 00:00, until 00:00) of the zone; a time without zone counts as UTC.

    The bounds are constants of the column's own type, so the filter reaches the scan and prunes row groups.
    """
    def bound(day: str) -> Column:
        local = datetime.combine(date.fromisoformat(day), time.min, ZoneInfo(zone))
        return F.lit(local.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S+00:00" if kind == "timestamp" else "%Y-%m-%d %H:%M:%S")).cast(kind)

    kind = df.schema[ts].dataType.simpleString()
    return (F.col(ts) >= bound(since)) & (F.col(ts) < bound(until))


def newest_in_window(df: DataFrame, ts: str, since: str, until: str, limit: int, tie: str) -> DataFrame:
    """The latest ``limit`` rows of the window, oldest first."""
    return df.where(day_window(df, ts, since, until)).orderBy(F.desc(ts), F.desc(tie)).limit(limit).orderBy(ts, tie)


def oldest_after_mark(df: DataFrame, key: str, mark: int, limit: int) -> DataFrame:
    """The first ``limit`` rows above the mark; a mark of 0 is no mark. What is beyond waits for the next run."""
    return (df.where(F.col(key) > mark) if mark else df).orderBy(key).limit(limit)


def high_marks(keys: DataFrame, key: str) -> DataFrame:
    """Greatest message number of each chat among keys ``chat:number``; other keys are members without a number."""
    m = F.regexp_extract(key, r"^(-?\d+):(\d+)$", 2).try_cast("bigint")
    return keys.select(F.regexp_extract(key, r"^(-?\d+):", 1).try_cast("bigint").alias("chat_id"), m.alias("n")).where("n is not null").groupBy("chat_id").agg(F.max("n").alias("max_msg_id"))


def above_marks(df: DataFrame, marks: DataFrame, chat: str, number: str) -> DataFrame:
    """Rows above the mark of their chat; a chat without a mark keeps all."""
    m = marks.select(F.col("chat_id").alias("__c"), F.col("max_msg_id").alias("__m"))
    return df.join(m, df[chat] == F.col("__c"), "left").where(F.col("__m").isNull() | (F.col(number) > F.col("__m"))).drop("__c", "__m")


#: Values of the order that make a segment of a source.
SEGMENT = 4096


def segmented(df: DataFrame, source: str, order: str, radius: int, size: int | None = None) -> tuple[DataFrame, list[str]]:
    """Rows of each source cut into segments of the numeric ``order``, each with the ``radius`` rows before and after it, and the columns to group by.

    A window over source and segment sees of a row's ``radius`` neighbours what one over the source would, however far the
    segments lie apart; rows of ``__halo`` only stand by.  A source of any size is spread over its segments: what a segment lends to others
    comes from one row a segment.
    """
    rows = df.withColumn("__seg", F.floor(F.col(order) / (size or SEGMENT)))
    line = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*df.columns).alias("r"))))
    ends = rows.groupBy(source, "__seg").agg(line.alias("l")).select(source, "__seg", F.slice("l", 1, radius).alias("first"), F.slice(F.reverse("l"), 1, radius).alias("last"))
    w = Window.partitionBy(source).orderBy("__seg")
    before = F.slice(F.flatten(F.reverse(F.collect_list("last").over(w.rowsBetween(-radius, -1)))), 1, radius)
    after = F.slice(F.flatten(F.collect_list("first").over(w.rowsBetween(1, radius))), 1, radius)
    lent = ends.select("__seg", before.alias("b"), after.alias("a")).select("__seg", F.explode(F.concat("b", "a")).alias("e")).select("e.r.*", "__seg", F.lit(True).alias("__halo"))
    return rows.withColumn("__halo", F.lit(False)).unionByName(lent), [source, "__seg"]


def neighbours_text(df: DataFrame, source: str, order: str, sender: str, text: str, radius: int = 3) -> DataFrame:
    """Each row with ``context``: the non-blank messages ``radius`` before to after it in its source."""
    rows, by = segmented(df, source, order, radius)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-radius, radius)
    line = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.concat(F.coalesce(F.col(sender), F.lit("unknown")), F.lit(": "), F.trim(F.col(text))))
    return rows.withColumn("context", F.array_join(F.collect_list(line).over(w), "\n")).where("not __halo").select(*df.columns, "context")


def around_flagged(df: DataFrame, flagged: Column, candidate: Column, source: str, order: str) -> DataFrame:
    """Flagged rows, and candidates right before or after a flagged one in their source."""
    rows, by = segmented(df, source, order, 1)
    w = Window.partitionBy(*by).orderBy(order)
    d = rows.withColumn("__f", flagged).withColumn("__b", F.lag("__f").over(w)).withColumn("__a", F.lead("__f").over(w))
    return d.where("not __halo").where(F.col("__f") | (candidate & F.coalesce(F.col("__b") | F.col("__a"), F.col("__b"), F.col("__a"), F.lit(False)))).select(*df.columns)
