"""Streams: replay, crash between sink and commit, late rows, throttle, restart by offset."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quaylight.sources.offsets import MessageFiles
from quaylight.streaming import forward, windows

T0 = dt.datetime(2024, 1, 1)


def batch(spark, rows):
    return spark.createDataFrame(rows, "seq long, key string")


def sent(spark, work):
    return sorted((r.seq, r.key) for r in spark.read.parquet(f"{work}/sent").collect())


def test_replay_and_crash(spark, tmp_path):
    f = forward.forwarder(f"{tmp_path}/sent", f"{tmp_path}/seen", F.col("key"), ["seq"])
    f(batch(spark, [(1, "a"), (2, "a"), (3, None)]), 0)
    f(batch(spark, [(4, "a"), (5, "b")]), 1)
    want = [(1, "a"), (3, None), (5, "b")]
    assert sent(spark, tmp_path) == want
    f(batch(spark, [(4, "a"), (5, "b")]), 1)  # replay of the last batch
    assert sent(spark, tmp_path) == want
    import shutil

    shutil.rmtree(tmp_path / "seen" / "b=1")  # the run died after the sink, before the commit
    f(batch(spark, [(4, "a"), (5, "b")]), 1)
    f(batch(spark, [(6, "b"), (7, "c")]), 2)
    assert sent(spark, tmp_path) == want + [(7, "c")]


def test_folded_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forward, "MERGE", 2)
    f = forward.forwarder(f"{tmp_path}/sent", f"{tmp_path}/seen", F.col("key"), ["seq"])
    want = []
    for n in range(7):
        rows = [(10 * n, "a"), (10 * n + 1, f"k{n}"), (10 * n + 2, f"k{n - 1}")]
        for _ in range(2):  # each is replayed
            f(batch(spark, rows), n)
        want += [(0, "a"), (1, "k0"), (2, "k-1")] if n == 0 else [(10 * n + 1, f"k{n}")]
    assert sent(spark, tmp_path) == want
    assert [x.name for x in sorted((tmp_path / "seen").iterdir()) if x.name.startswith("f=")] == ["f=2", "f=4"]


def test_window_forgets(spark, tmp_path):
    f = forward.forwarder(f"{tmp_path}/sent", f"{tmp_path}/seen", F.col("key"), ["seq"], "ts", 1.0)
    mk = lambda rows: spark.createDataFrame([(s, k, T0 + dt.timedelta(hours=h)) for s, k, h in rows], "seq long, key string, ts timestamp")
    f(mk([(1, "a", 0)]), 0)
    f(mk([(2, "a", 10)]), 1)
    f(mk([(3, "a", 30)]), 2)
    assert sent(spark, tmp_path) == [(1, "a"), (3, "a")]


def land(spark, tmp_path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_late_rows_are_dropped(spark, tmp_path):
    h = lambda x: T0 + dt.timedelta(hours=x)
    src = land(spark, tmp_path, [[(h(0), "a"), (h(1), "a")], [(h(30), "a")], [(h(31), "b")], [(h(2), "late")], [(h(80), "a")]], "ts timestamp, k string")
    got = {(r.window_start.day, r.k): r.n for r in windows.drained(spark, windows.tumbling_counts(src, "ts", ["k"], "1 day", "2 hours"), str(tmp_path)).collect()}
    assert got == {(1, "a"): 2, (2, "a"): 1, (2, "b"): 1}  # rows are late by the mark of the batch before


def test_throttle(spark, tmp_path):
    m = lambda x: T0 + dt.timedelta(minutes=x)
    src = land(spark, tmp_path, [[("a", m(0)), ("a", m(5)), ("b", m(1))], [("a", m(19)), ("a", m(20)), ("a", m(39)), ("a", m(41))]], "k string, ts timestamp")
    got = sorted((r.k, r.ts) for r in windows.drained(spark, windows.throttled(src, "k", "ts", 1200), str(tmp_path)).collect())
    assert got == [("a", m(0)), ("a", m(20)), ("a", m(41)), ("b", m(1))]


def test_offset_source_goes_on(spark, tmp_path):
    spark.dataSource.register(MessageFiles)
    src = tmp_path / "src"
    src.mkdir()
    put = lambda n, ids: (src / n).write_text("".join(json.dumps({"msg_id": i, "chat_id": "c", "text": "t"}) + "\n" for i in ids) + "bad\n")

    def run():
        q = spark.readStream.format("message_files").option("path", str(src)).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.msg_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("a.jsonl", [1, 2, 3])
    assert run() == [1, 2, 3]
    put("b.jsonl", [4, 5])
    assert run() == [1, 2, 3, 4, 5]
