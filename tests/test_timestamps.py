"""Timestamps against the standard library, one value at a time."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.functions.zones import ZoneTable
from quaylight.operators.timestamps import normalize_times, parse_many

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ZONES = ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "Asia/Shanghai", "UTC"]


def us(d: datetime) -> int:
    return (d.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


def one(text, zone=None, order=None):
    t = ZoneTable.build(ZONES)
    v, ok = parse_many([text], [zone], [order], t)
    return int(v[0]) if ok[0] else None


def test_wall_times_agree_with_zoneinfo_around_all_changes():
    t = ZoneTable.build(ZONES)
    for z in ZONES:
        walls = [datetime(2024, m, 1) + timedelta(minutes=30 * k) for m in (3, 4, 10, 11) for k in range(48 * 30)]
        got, ok = parse_many([w.strftime("%Y-%m-%d %H:%M") for w in walls], [z] * len(walls), [None] * len(walls), t)
        assert ok.all()
        # fold=0 is the earlier of two instants, and reads a gap with the offset before it
        assert got.tolist() == [us(w.replace(tzinfo=ZoneInfo(z), fold=0)) for w in walls]


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("1704195418", None, None, 1704195418_000000),
        ("１７０４１９５４１８", None, None, 1704195418_000000),
        ("1704195418446", None, None, 1704195418_446000),
        ("1704067200247905", None, None, 1704067200_247905),
        ("1705474811.818", None, None, 1705474811_818000),
        ("20240104181847", "Asia/Shanghai", None, us(datetime(2024, 1, 4, 10, 18, 47, tzinfo=timezone.utc))),
        ("20240104T181847Z", "Asia/Shanghai", None, us(datetime(2024, 1, 4, 18, 18, 47, tzinfo=timezone.utc))),
        ("2024-01-03 15:43:50 CST", "Asia/Shanghai", None, us(datetime(2024, 1, 3, 7, 43, 50, tzinfo=timezone.utc))),
        ("2024-01-03 15:43:50 CST", "America/New_York", None, us(datetime(2024, 1, 3, 21, 43, 50, tzinfo=timezone.utc))),
        ("2024-11-03 01:30:00 EST", "America/New_York", None, us(datetime(2024, 11, 3, 6, 30, tzinfo=timezone.utc))),
        ("2024-11-03 01:30:00", "America/New_York", None, us(datetime(2024, 11, 3, 5, 30, tzinfo=timezone.utc))),
        ("Sun, 07 Jan 2024 06:15:28 +0800", None, None, us(datetime(2024, 1, 6, 22, 15, 28, tzinfo=timezone.utc))),
        ("2024-01-09T17:44:19.692212404+11:00", None, None, us(datetime(2024, 1, 9, 6, 44, 19, 692212, tzinfo=timezone.utc))),
        ("2024-01-01T08:00:00-05[America/New_York]", None, None, us(datetime(2024, 1, 1, 13, tzinfo=timezone.utc))),
        ("2024-01-01T08:00:00[America/New_York]", None, None, us(datetime(2024, 1, 1, 13, tzinfo=timezone.utc))),
        ("3/8/2024 2:42 PM", "UTC", "dmy", us(datetime(2024, 8, 3, 14, 42, tzinfo=timezone.utc))),
        ("3/8/2024 2:42 PM", "UTC", "mdy", us(datetime(2024, 3, 8, 14, 42, tzinfo=timezone.utc))),
        ("24.2.2024 20:02:15", "UTC", None, us(datetime(2024, 2, 24, 20, 2, 15, tzinfo=timezone.utc))),
        ("2024年5月8日 下午11:14", "UTC", None, us(datetime(2024, 5, 8, 23, 14, tzinfo=timezone.utc))),
        ("2025年1月16日 上午12:51", "UTC", None, us(datetime(2025, 1, 16, 0, 51, tzinfo=timezone.utc))),
        ("Jan 1, 2024 12:00:00 AM", "UTC", None, us(datetime(2024, 1, 1, tzinfo=timezone.utc))),
        ("　 2024/7/31 12:37\n", "UTC", None, us(datetime(2024, 7, 31, 12, 37, tzinfo=timezone.utc))),
        ("2024-02-29", "Asia/Shanghai", None, us(datetime(2024, 2, 28, 16, tzinfo=timezone.utc))),
    ],
)
def test_forms(text, zone, order, want):
    assert one(text, zone, order) == want


@pytest.mark.parametrize("text", [None, "", "  ", "N/A", "-", "刚刚", "昨天 20:15", "25:61", "2025-02-30 10:00", "2025-13-05T10:00:00Z", "0000-00-00 00:00:00", "2024-11-31", "2024-01-01 10:00 XYZ", "9" * 500])
def test_no_instant(text):
    assert one(text, "UTC") is None


def test_operator_with_nulls_repeats_and_clashing_names(spark):
    clock = spark.createDataFrame([("a", "Asia/Shanghai", "ymd"), ("a", "Asia/Shanghai", "ymd"), (None, "Asia/Tokyo", "ymd")], "source string, zone string, date_order string")
    rows = [(1, "2024-01-01", "a", "x"), (1, "2024-01-01", "a", "x"), (2, None, "a", "y"), (3, "2024-01-01", None, "z"), (4, "2024-01-01", "unknown", "z")]
    df = spark.createDataFrame(rows, "seq long, time string, source string, zone string")
    got = sorted(tuple(r) for r in normalize_times(df, "time", "source", clock).select("seq", "utc_us", "zone").collect() if r)
    day = us(datetime(2024, 1, 1, tzinfo=timezone.utc))
    want = [(1, day - 8 * 3600 * 10**6, "x")] * 2 + [(2, None, "y"), (3, day, "z"), (4, day, "z")]
    assert got == sorted(want, key=lambda r: r[0])
    assert normalize_times(df.where("false"), "time", "source", clock).count() == 0


def test_micros_drop_finer_digits():
    assert one("2024-01-01T00:00:00.1234569Z") == us(datetime(2024, 1, 1, 0, 0, 0, 123456, tzinfo=timezone.utc))
    assert np.int64(one("2024-01-01T00:00:00.5Z")) % 10**6 == 500000


def test_texts_are_read_whole(spark):
    df = spark.createDataFrame([(" " * 50_000 + "2024-01-02 03:04:05" + "\u200b" * 2000,), ("2024-01-02 03:04:05 " + "x" * 90_000,)], "t string").withColumn("s", F.lit("a"))
    clock = spark.createDataFrame([("a", "UTC", "ymd")], "source string, zone string, date_order string")
    assert [r.utc_us for r in normalize_times(df, "t", "s", clock).collect()] == [1704164645000000, None]
    many = spark.range(10_001).select(F.col("id").cast("string").alias("source"), F.concat(F.lit("Z/"), "id").alias("zone"), F.lit("ymd").alias("date_order"))
    with pytest.raises(ValueError):
        normalize_times(df, "t", "s", many)
