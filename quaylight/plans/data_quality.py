"""Queries of the general data problems: timestamps and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.operators.spikes import distrusted, score_readings, suspected
from quaylight.operators.timestamps import normalize_times
from quaylight.plans.registry import query
from quaylight.sources.tables import table

TIME_FIELDS = {"content_seen": ("sent_at", "channel"), "media_candidates": ("timestamp", "group_name"), "bili_videos": ("publish_time", "subscription_name")}
VITALS = {"resting_hr": (25.0, 150.0), "hrv_ms": (1.0, 300.0), "steps": (0.0, 100000.0)}


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Instant of each row whose time names one: tbl, seq, utc_us."""
    parts = [table(spark, d, t).select(F.lit(t).alias("tbl"), "seq", F.col(f).alias("time_text"), F.col(s).alias("time_source")) for t, (f, s) in TIME_FIELDS.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("time_text is not null")
    return normalize_times(rows, "time_text", "time_source", table(spark, d, "source_clock")).where("utc_us is not null").select("tbl", "seq", "utc_us")


P4_SQL = """
with r as (select distinct * from activity_days),
l as (select device_id, report_day, 'resting_hr' as metric, resting_hr as x from r
      union all select device_id, report_day, 'hrv_ms', hrv_ms from r
      union all select device_id, report_day, 'steps', steps from r),
v as (select * from l where x is not null),
m as (select *, median(x) over w as med, list(x) over w as xs,
        row_number() over (partition by device_id, metric order by report_day) as i
      from v window w as (partition by device_id, metric order by report_day range between interval 30 days preceding and interval 30 days following)),
d as (select *, list_median(list_transform(xs, lambda y: abs(y - med))) as mad from m),
g as (select *, sum(new) over (partition by device_id, metric order by i) as run_no
      from (select *, case when x = lag(x) over (partition by device_id, metric order by i) then 0 else 1 end as new from d)),
n as (select *, count(*) over (partition by device_id, metric, run_no) as run_len from g)
select device_id, strftime(report_day, '%Y-%m-%d') as report_day, metric from n
where (metric = 'resting_hr' and (x < 25 or x > 150)) or (metric = 'hrv_ms' and (x < 1 or x > 300)) or (metric = 'steps' and (x < 0 or x > 100000))
   or (mad > 0 and abs(x - med) > 8 * mad + 1e-9) or run_len >= 5
"""


@query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings to be distrusted: device_id, report_day, metric."""
    bad = distrusted(score_readings(table(spark, d, "activity_days"), "device_id", "report_day", VITALS))
    return bad.select(F.col("source").alias("device_id"), F.date_format("day", "yyyy-MM-dd").alias("report_day"), "metric")


@query("p4_states")
def p4_states(spark: SparkSession, d: str) -> DataFrame:
    """What each device's own model makes of its readings: device_id, metric, state, readings, and how many of them a stated rule names too."""
    s = suspected(score_readings(table(spark, d, "activity_days"), "device_id", "report_day", VITALS))
    return s.groupBy(F.col("source").alias("device_id"), "metric", "state").agg(F.count("*").alias("readings"), F.count_if("ruled").alias("ruled"))
