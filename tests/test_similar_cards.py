"""Cards that are alike within two days, against the SQL."""

import random
from datetime import UTC, datetime, timedelta

import duckdb

from quaylight.operators import topk
from quaylight.plans import core_queries, core_sql


def test_similar_recent_cards_as_sql(spark, tmp_path, monkeypatch):
    """Dense cards in blocks, with multiples of one vector (whose cosines differ in the last bit or not), equal times, repeats and unusable rows; no join makes the pairs."""
    monkeypatch.setattr(topk, "BAND_BLOCK", 32, raising=False)
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(48)] for _ in range(9)]
    rows = []
    for i in range(700):
        f = r.choice([1.0, 0.1, 0.3, 3.0, 7.7])
        v = [x * f + (r.gauss(0, 0.3) if i % 3 == 0 else 0.0) for x in r.choice(base)]
        v = {50: None, 51: [], 52: v[:47], 53: [0.0] * 48, 54: [float("nan")] * 48, 55: [float("inf"), *v[1:]]}.get(i, v)
        at = datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=r.choice([0, 48, 47, r.uniform(-60, 300), r.uniform(0, 48)]))
        rows.append((None if i == 60 else i, None if i == 61 else at, r.choice(["x_monitor", "other", "growth"]), v))
    rows += rows[:20] + [(30, rows[30][1], "alert", rows[30][3])]
    df = spark.createDataFrame(rows, "msg_id long, ts timestamp, producer string, embedding array<double>")
    df.write.parquet(str(tmp_path / "delivered.parquet"))
    found = core_queries()["similar_recent_cards"](spark, str(tmp_path))
    got = sorted(map(repr, map(tuple, found.collect())))
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    db.execute(f"create view delivered as select * from '{tmp_path}/delivered.parquet/*.parquet'")
    assert len(got) > 800 and got == sorted(map(repr, db.execute(core_sql()["similar_recent_cards"]).fetchall()))
    assert "zip_with" not in found._jdf.queryExecution().toString()
