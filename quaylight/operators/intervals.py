"""Joins on ranges by equality of buckets, so that they hash instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over the narrower length; both ends count."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    return shared / F.least(e1 - s1 + 1, e2 - s2 + 1)


def overlapping_pairs(df: DataFrame, key: str, group: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs a < b of one group whose intervals meet, with ``ratio``.

    Buckets double in width from level to level, and an interval lies in the one or two buckets it touches at the level
    of its own width, so a wide one is no more rows than a narrow one.  It is looked up at its own and all wider levels; a pair is taken at
    the level of the wider, in the first bucket that both touch.
    """
    d = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s <= e")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("e") - F.col("s") + 1) / bucket))).cast("int")
    d = d.withColumn("level", level)
    width = F.lit(bucket) * F.pow(F.lit(2.0), F.col("at"))
    touched = lambda x: x.withColumn("w", width).withColumn("bk", F.explode(F.sequence(F.floor(F.col("s") / F.col("w")), F.floor(F.col("e") / F.col("w")))))
    own = touched(d.withColumn("at", F.col("level"))).select(F.col("k").alias("y"), "g", "at", "bk", F.col("s").alias("s2"), F.col("e").alias("e2"))
    top = d.groupBy("g").agg(F.max("level").alias("top"))
    sought = touched(d.join(top, "g").withColumn("at", F.explode(F.sequence("level", "top")))).select(F.col("k").alias("x"), "g", "at", "bk", "w", "level", F.col("s").alias("s1"), F.col("e").alias("e1"))
    j = sought.join(own, ["g", "at", "bk"]).where("s1 <= e2 and s2 <= e1 and (level < at and x <> y or x < y)").where(F.col("bk") == F.floor(F.greatest("s1", "s2") / F.col("w")))
    ratio = overlap_ratio(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    return j.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("g").alias(group), ratio.alias("ratio"))


def members(spans: DataFrame, points: DataFrame, span_key: str, group: str, start: str, end: str, point_group: str, point: str, bucket: int) -> DataFrame:
    """Points inside each span of their group: span key, then the points' columns."""
    s = spans.select(F.col(span_key).alias("__k"), F.col(group).alias("__g"), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e")).where("__s <= __e")
    s = s.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / bucket), F.floor(F.col("__e") / bucket))))
    p = points.withColumn("__g", F.col(point_group)).withColumn("__b", F.floor(F.col(point).cast("long") / bucket))
    return s.join(p, ["__g", "__b"]).where(F.col(point).between(F.col("__s"), F.col("__e"))).drop("__g", "__b", "__s", "__e").withColumnRenamed("__k", f"span_{span_key}")


def band_pairs(df: DataFrame, key: str, ts: str, width_us: int, extra: list[str]) -> DataFrame:
    """Pairs of rows less than ``width_us`` apart in time, the earlier as a (ties by key), with columns a_*, b_*.

    Each row is looked up in its own time bucket and the next one.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    d = df.select(F.col(key).alias("k"), us.alias("us"), *extra).withColumn("bk", F.floor(F.col("us") / width_us))
    a = d.withColumn("bk", F.explode(F.array(F.col("bk"), F.col("bk") + 1)))
    cols = ["k", "us", *extra]
    a = a.select("bk", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = d.select("bk", *[F.col(c).alias(f"b_{c}") for c in cols])
    later = (F.col("b_us") > F.col("a_us")) | ((F.col("b_us") == F.col("a_us")) & (F.col("b_k") > F.col("a_k")))
    return a.join(b, "bk").where(later & (F.col("b_us") - F.col("a_us") < width_us)).drop("bk")


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Each left row with the latest right ``value`` of its ``by`` at or before its time: one union and one running window."""
    from pyspark.sql import Window

    extra = [c for c in left.columns if c not in (by, ts)]
    lf = left.select(by, ts, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), *extra)
    rf = right.select(by, ts, F.lit(0).alias("__side"), F.col(value).alias("__v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra])
    w = Window.partitionBy(by).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return lf.unionByName(rf).withColumn("asof_value", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "__v")
