"""Tolerant readings of numbers, flags, durations and clock values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of flags.
TRUE_WORDS = ("true", "yes", "y", "1", "是", "同一事件", "same")
FALSE_WORDS = ("false", "no", "n", "0", "否", "不是", "different")
#: Seconds from 1970-01-01 to 2001-01-01 UTC, the epoch of the device exports.
DEVICE_EPOCH = 978307200


def whole_number(text: Column) -> Column:
    """The integer that a text spells, blanks aside; null for anything else, fractions included."""
    t = F.trim(text.cast("string"))
    n = t.try_cast("double")
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")).when(t.rlike(r"^[+-]?\d+\.0*$") & (n == F.floor(n)), n.cast("bigint"))


def score_to_ten(x: Column) -> Column:
    """0 to 10; anything else is 0, never the nearest bound."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 0) | (v > 10), 0.0).otherwise(v)


def score_to_one(x: Column) -> Column:
    """0 to 1; scores up to 10 and up to 100 are scaled down, anything else is 0."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 0) | (v > 100), 0.0).when(v <= 1, v).when(v <= 10, v / 10).otherwise(v / 100)


def flag(x: Column, default: bool = False) -> Column:
    """A flag in any of the known spellings, else the default."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).otherwise(default)


def one_of(x: Column, allowed: list[str], default: str) -> Column:
    """The value if it is one of a closed set, else the default."""
    return F.when(x.isin(*allowed), x).otherwise(default)


def iso_duration_seconds(text: Column) -> Column:
    """Seconds of ``P1DT2H3M4S``; null if it isn't one or has no part."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0))
    return F.when(text.rlike(pattern) & text.rlike(r"\d"), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def clock_duration_seconds(text: Column) -> Column:
    """Seconds of ``1h2m3s``."""
    pattern = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0))
    return F.when(text.rlike(pattern) & text.rlike(r"\d"), part(1) * 3600 + part(2) * 60 + part(3))


def duration_text(seconds: Column) -> Column:
    """``1h2m3s`` without leading zero parts; null unless positive."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.concat(F.when(h > 0, F.concat(h, F.lit("h"))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m, F.lit("m"))).otherwise(""), F.concat(r, F.lit("s")))
    return F.when(s > 0, text)


def epoch_seconds(x: Column) -> Column:
    """Timestamp of seconds since 1970 up to 2100; null outside, so milliseconds aren't mistaken."""
    v = x.try_cast("bigint")
    return F.when((v > 0) & (v <= 4102444800), F.timestamp_seconds(v))


def device_time(x: Column) -> Column:
    """Timestamp of seconds since 2001-01-01 UTC."""
    return F.timestamp_seconds(x.try_cast("double") + DEVICE_EPOCH)


def ratio(value: Column, base: Column) -> Column:
    """value / base, null unless the base is positive."""
    return F.when(base > 0, value / base)


def trend_mark(r: Column) -> Column:
    """↑ from 1.2, ↓ to 0.8, = between, – for none."""
    return F.when(r.isNull(), "–").when(r >= 1.2, "↑").when(r <= 0.8, "↓").otherwise("=")


def percent_delta(value: Column, base: Column) -> Column:
    """Signed whole percent of the change from the base; empty without one."""
    return F.when(value.isNull() | base.isNull() | (base == 0), "").otherwise(F.format_string("%+.0f%%", F.bround((value / base - 1) * 100, 0)))


def clock_minutes(ts: Column) -> Column:
    """Minute of the day."""
    return F.hour(ts) * 60 + F.minute(ts)


def year_progress(day: Column) -> Column:
    """Share of the year that is over, leap years counted."""
    days = F.datediff(F.add_months(F.trunc(day, "year"), 12), F.trunc(day, "year"))
    return F.dayofyear(day) / days
