"""Personal measurement exports: interval records with their completeness, sleep episodes, activity days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions.coerce import device_time
from quaylight.operators.sessions import numbered_sessions

# Metrics of a day with their units, and the stages of sleep.
TOTALS = {"active_energy": "kcal", "apple_exercise_time": "min", "apple_stand_hour": "count", "step_count": "count", "walking_running_distance": "km"}
MEANS = {"resting_heart_rate": "count/min", "heart_rate_variability": "ms"}
STAGES = ("core", "deep", "rem", "awake")
ASLEEP = ("core", "deep", "rem")
RECORD = "metric string, start double, end double, unit string, qty double, stage string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of files <day>.json, of which a file is complete if written after its UTC day."""
    day = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    raw = spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(path)
    raw = raw.select("*", day.alias("file_day"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))
    return raw.withColumn("complete", F.col("at") >= F.date_add("file_day", 1).cast("timestamp")).withColumn("starts_at", device_time(F.col("start"))).withColumn("ends_at", device_time(F.col("end")))


def distinct_records(df: DataFrame) -> DataFrame:
    """The last of the records equal in metric, start, end, unit and stage; those of later files win."""
    keys = ["metric", "start", "end", "unit", "stage"]
    w = Window.partitionBy(*keys).orderBy(F.desc("file_day"), F.desc("file"))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overlapping(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return df.where((F.col("ends_at") > lo) & (F.col("starts_at") < hi))


def activity_days(df: DataFrame, zone: str) -> DataFrame:
    """day and the totals and means; null unless every record of a metric comes from a complete file."""
    day = F.to_date(F.from_utc_timestamp("starts_at", zone))
    aggs = []
    for m, unit in {**TOTALS, **MEANS}.items():
        hit = (F.col("metric") == m) & (F.col("unit") == unit) & F.col("qty").isNotNull()
        value = F.sum(F.when(hit, F.col("qty"))) if m in TOTALS else F.avg(F.when(hit, F.col("qty")))
        aggs.append(F.when(F.min(F.when(hit, F.coalesce("complete", F.lit(False)))), value).alias(m))
    return df.groupBy(day.alias("day")).agg(*aggs)


def sleep_episodes(df: DataFrame, by: str, starts: str, ends: str, stage: str, gap_minutes: int = 90, least_hours: float = 2.0) -> DataFrame:
    """by, started, ended, hours of each stage, asleep: stages with at most the gap between them form an episode.

    Overlapping stages add up; an episode asleep for less than ``least_hours`` is a nap and left out.
    """
    rows = df.where(F.col(ends) > F.col(starts))
    rows = numbered_sessions(rows, by, F.col(starts), F.col(ends), [starts, ends], gap_minutes * 60_000_000)
    hours = (F.unix_micros(F.col(ends).cast("timestamp")) - F.unix_micros(F.col(starts).cast("timestamp"))) / 3.6e9
    parts = [F.sum(F.when(F.col(stage) == s, hours).otherwise(0.0)).alias(s) for s in STAGES]
    out = rows.groupBy(by, "session").agg(F.min(starts).alias("started"), F.max(ends).alias("ended"), *parts)
    return out.withColumn("asleep", sum((F.col(s) for s in ASLEEP), F.lit(0.0))).where(F.col("asleep") >= least_hours).drop("session")


def longest_by_day(episodes: DataFrame, by: str) -> DataFrame:
    """The longest episode that ends on each day."""
    day = F.to_date("ended")
    rest = [c for c in episodes.columns if c != by]
    return episodes.groupBy(by, day.alias("wake_day")).agg(F.max_by(F.struct(*rest), F.struct("asleep", "ended")).alias("__r")).select(by, "wake_day", "__r.*")


def workout_summaries(workouts: DataFrame) -> DataFrame:
    """name, started, ended, duration_min, active_kcal, distance_km of workouts (name, start, end, duration, activeEnergy, totalDistance as text or number).

    Times are of the device's epoch, durations seconds, energy kilojoules; what can't be read counts as 0, and no energy or distance is null.
    """
    from quaylight.functions.coerce import device_time

    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    positive = lambda x: F.when(x > 0, x)
    name = F.coalesce(F.nullif(F.col("name").cast("string"), F.lit("")), F.lit("Workout"))
    return workouts.select(name.alias("name"), device_time(F.col("start")).alias("started"), device_time(F.col("end")).alias("ended"), (number("duration") / 60).alias("duration_min"), positive(number("activeEnergy") / 4.184).alias("active_kcal"), positive(number("totalDistance")).alias("distance_km"))
