"""Operators against direct readings of their rules."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.operators import clusters, dedup, intervals, scan, series, sessions, state, topk

T0 = dt.datetime(2024, 1, 1)


def test_chat_ids():
    assert scan.chat_ids(-1001234) == [-1001234, 1234, 1001234] and scan.chat_ids("77") == [-10077, 77, 10077] and scan.chat_ids(-77) == [-10077, -77, 77, 10077]


def test_paging_modes(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(hours=i)) for i in range(100)], "msg_id long, ts timestamp_ntz")
    new = [r.msg_id for r in scan.newest_in_window(df, "ts", "2024-01-02", "2024-01-04", 5, "msg_id").collect()]
    assert new == [59, 60, 61, 62, 63]  # local days begin eight hours earlier
    assert [r.msg_id for r in scan.oldest_after_mark(df, "msg_id", 10, 3).collect()] == [11, 12, 13]
    assert scan.oldest_after_mark(df, "msg_id", 0, 3).count() == 3


def test_rolling_owner(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc") if i % 9 else None, T0 + dt.timedelta(hours=rng.randint(0, 400)), i) for i in range(400)]
    rows += [("hot", T0 + dt.timedelta(minutes=i), 1000 + i) for i in range(300)]
    got = {r.id: r.owner for r in dedup.rolling_owners(spark.createDataFrame(rows, "key string, ts timestamp, id long"), "key", "ts", "id", 1.0).collect()}
    want, open_ = {}, {}
    for k, t, i in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], r[2])):
        if k not in open_ or t - open_[k][0] >= dt.timedelta(days=1):
            open_[k] = (t, i)
        want[i] = open_[k][1]
    assert got == want


def test_greedy_intervals(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, s := rng.randint(0, 300), s + rng.randint(0, 40)) for i in range(150)]
    got = {r.i for r in dedup.greedy_intervals(spark.createDataFrame(rows, "i long, g long, s long, e long"), "g", "s", "e", "i").collect()}
    want, kept = set(), {}
    for i, g, s, e in rows:
        if all(max(0, min(e, f) - max(s, t) + 1) / min(e - s + 1, f - t + 1) < 0.5 for t, f in kept.get(g, [])):
            kept.setdefault(g, []).append((s, e))
            want.add(i)
    assert got == want


def test_first_last_and_empty(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 0, "y")], "k string, n int, v string")
    assert [tuple(r) for r in dedup.first_owner(df, "k", ["n"]).collect()] == [("a", 1, "x", 2)]
    assert {tuple(r) for r in dedup.last_wins(df, ["k"], ["n"]).collect()} == {("a", 2, None), (None, 0, "y")}
    assert dedup.first_owner(df.where("false"), "k", ["n"]).count() == 0


def test_versioned_table(spark, tmp_path):
    t = state.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.read() is None
    a = spark.createDataFrame([("k1", 1)], "key string, n int")
    assert t.write(a) == 1
    new = spark.createDataFrame([("k1", 9), ("k2", 5), ("k2", 4)], "key string, n int")
    assert t.write(state.appended_if_absent(t.read(), new, "key", ["n"]), expect=1) == 2
    assert {tuple(r) for r in t.read().collect()} == {("k1", 1), ("k2", 4)}
    with pytest.raises(RuntimeError):
        t.write(a, expect=1)
    (tmp_path / "t" / "data-dead").mkdir()  # a run that died
    assert t.version() == 2 and {tuple(r) for r in t.read(1).collect()} == {("k1", 1)}


def test_of_two_writers_one_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    state.VersionedTable(spark, path).write(spark.createDataFrame([(0,)], "n int"))

    def write(n):
        try:
            return state.VersionedTable(spark, path).write(spark.createDataFrame([(n,)], "n int"), expect=1)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(1, 5)))
    assert sorted(x for x in done if x) == [2]
    assert state.VersionedTable(spark, path).read().collect()[0].n == done.index(2) + 1


def test_leases_and_marks(spark):
    df = spark.createDataFrame([("a", "sending", "r1", None, None), ("b", "sending", "r2", None, None), ("c", "pending", None, None, None)], "id string, status string, owner string, sent_at string, sent_style string").withColumn("lease_until", F.lit("2024-01-01").cast("timestamp"))
    row = lambda t, k: {r.id: r for r in t.collect()}[k]
    assert row(state.released(df, "id", "a", "r1"), "a").status == "pending" and row(state.released(df, "id", "a", "r2"), "a").owner == "r1"
    assert str(row(state.renewed(df, "id", "a", "r1", "2024-06-01 00:00:00", 60), "a").lease_until) == "2024-06-01 00:01:00"
    assert state.renewed(df, "id", "c", "r1", "2024-06-01", 60).collect() == df.collect()
    assert row(state.sent(df, "id", "b", "A", "t", "r1"), "b").status == "sending"
    done = row(state.sent(df, "id", "b", "A", "t", "r2"), "b")
    assert (done.status, done.owner, done.sent_at, done.lease_until) == ("sent", None, "t", None) and row(state.sent(df, "id", "c", "A", "t"), "c").status == "sent"
    t = spark.createDataFrame([("x", "active", "old"), ("y", "active", None)], "id string, status string, death_signal string")
    marks = spark.createDataFrame([("x", 1, "dead", "why"), ("x", 2, "likely_dead", None)], "id string, order int, status string, death_signal string")
    assert {tuple(r) for r in state.marked(t, marks, "id").collect()} == {("x", "likely_dead", "why"), ("y", "active", None)}
    assert {tuple(r) for r in state.marked(t, marks.where("false"), "id").collect()} == {("x", "active", "old"), ("y", "active", None)}


def test_fold_and_merge(spark):
    b = lambda rows: state.folded_mentions(spark.createDataFrame(rows, "k string, t int, g string, first_day string"), "k", ["t"], ["g"], ["first_day"])
    one = b([("a", 1, "x", "d1"), ("a", 2, "", "d2"), ("b", 1, None, "d1")])
    two = b([("a", 3, "z", "d3"), ("c", 3, "q", "d3")])
    got = {r.k: tuple(r)[1:] for r in state.merged_fold(one, two, "k", ["first_day"], ["g"]).collect()}
    assert got == {"a": ("d1", "z", 3), "b": ("d1", None, 1), "c": ("d3", "q", 1)}


def test_claim(spark):
    df = spark.createDataFrame([("a", 5.0, None, None), ("b", 9.0, "other", dt.datetime(2024, 1, 1)), ("c", 8.0, "other", dt.datetime(2030, 1, 1))], "id string, score double, owner string, lease_until timestamp")
    got = {r.id: r.owner for r in state.claimed(df, "me", "2024-06-01 00:00:00", 60, [F.desc("score")], "id").collect()}
    assert got == {"a": None, "b": "me", "c": "other"}


def test_overlap_and_members(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, s := rng.randint(-50, 500), s + rng.randint(0, 90)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, g long, s long, e long")
    got = {(r.a, r.b): round(r.ratio, 9) for r in intervals.overlapping_pairs(df, "id", "g", "s", "e", 32).collect()}
    want = {}
    for i, g, s, e in rows:
        for j, h, t, f in rows:
            if i < j and g == h and s <= f and t <= e:
                want[i, j] = round((min(e, f) - max(s, t) + 1) / min(e - s + 1, f - t + 1), 9)
    assert got == want
    pts = spark.createDataFrame([(k % 2, k) for k in range(0, 600, 7)], "c long, n long")
    m = {(r.span_id, r.n) for r in intervals.members(df, pts, "id", "g", "s", "e", "c", "n", 32).collect()}
    assert m == {(i, k) for i, g, s, e in rows for k in range(0, 600, 7) if k % 2 == g and s <= k <= e}


def test_band_pairs(spark):
    rows = [(i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 0, 5, 9, 10, 11, 30])]
    got = {(r.a_k, r.b_k) for r in intervals.band_pairs(spark.createDataFrame(rows, "k long, ts timestamp"), "k", "ts", 600_000_000, []).collect()}
    assert got == {(a, b) for a, t in rows for b, u in rows if dt.timedelta(0) <= u - t < dt.timedelta(minutes=10) and (t, a) < (u, b)}


def test_albums(spark):
    rows = [(1, 1, 0, "cap"), (1, 2, 5, ""), (1, 3, 20, None), (1, 4, 100, "  "), (1, 6, 101, ""), (1, 7, 102, "new"), (1, 8, 103, "")]
    df = spark.createDataFrame([(c, n, T0 + dt.timedelta(seconds=s), t) for c, n, s, t in rows], "chat long, n long, ts timestamp, txt string")
    assert {r.n: r["head"] for r in sessions.albums(df, "chat", "n", "ts", "txt", 15).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 6: 6, 7: 7, 8: 7}


def test_budget_chunks(spark):
    rows = [("a", i, T0 + dt.timedelta(minutes=m), 40) for i, m in enumerate([0, 1, 2, 3, 20, 21, 22, 23, 24, 25, 26, 60])]
    got = [r.chunk for r in sessions.budget_chunks(spark.createDataFrame(rows, "g string, i long, ts timestamp, n long"), "g", "i", "ts", F.col("n"), 100).orderBy("i").collect()]
    want, used, no, prev = [], 0, 0, None
    for _, i, t, n in rows:
        if i and (used >= 150 or (used >= 100 and t - prev >= dt.timedelta(minutes=10))):
            used, no = 0, no + 1
        want.append(no)
        used, prev = used + n + 1, t
    assert got == want


def test_streaks(spark):
    days = [("a", d) for d in (1, 2, 3, 5, 6)] + [("b", 9), ("b", 9), ("c", None)]
    df = spark.createDataFrame([(k, dt.date(2024, 1, d) if d else None) for k, d in days], "k string, d date")
    assert {r.k: (r.last_day.day, r.streak) for r in sessions.day_streaks(df, "k", F.col("d")).collect()} == {"a": (6, 2), "b": (9, 1)}


def test_trailing_median(spark):
    rows = [("d", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i) if i != 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "dev string, day date, x double")
    got = {r.day: r.m for r in df.select("day", series.trailing_median(df, "dev", "day", F.col("x")).alias("m")).collect()}
    assert got[dt.date(2024, 1, 1) + dt.timedelta(days=8)] is None  # six positive values
    assert got[dt.date(2024, 1, 1) + dt.timedelta(days=39)] == float(np.median(range(11, 39)))


def test_complete_totals(spark):
    df = spark.createDataFrame([("a", "m", 1.0, True), ("a", "m", 2.0, True), ("b", "m", 1.0, True), ("b", "m", 5.0, False), ("c", "n", 3.0, True)], "k string, metric string, v double, ok boolean")
    got = {r.k: (r.m, r.n) for r in series.complete_totals(df, ["k"], "metric", ["m", "n"], "v", F.col("ok")).collect()}
    assert got == {"a": (3.0, None), "b": (None, None), "c": (None, 3.0)}


def test_clusters_equal_full_comparison():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh汉字文本") for _ in range(30)) for _ in range(12)]
    lines = []
    for _ in range(80):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            s[rng.randrange(len(s))] = rng.choice("xyz")
        lines.append("".join(s)[: rng.randint(18, 30)])
    norm = [clusters.topic_letters(x) for x in lines]
    want, seeds = [], []
    for i, s in enumerate(norm):
        j = next((j for j in seeds if clusters.likeness(norm[j], s) >= 0.85), i)
        seeds += [i] if j == i else []
        want.append(j)
    assert clusters.seeds_of(lines) == want


def test_clusters_take_every_form_of_time(spark, tmp_path):
    from quaylight.plans import core_queries

    times = ["2024-01-02 01:00:00", "1704128400", "Tue, 02 Jan 2024 01:00:00 +0800", "2024年1月2日 01:00", "20240102010000", "2024/01/02 01:00", "2024-01-01T17:00:00Z", "2024-01-01 12:00:00", "yesterday", None]
    rows = [(i, f"g{i}", "A line that several groups report", t) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "seq long, group_name string, context string, timestamp string").write.parquet(str(tmp_path / "media_candidates.parquet"))
    spark.createDataFrame([(f"g{i}", "Asia/Shanghai", "ymd") for i in range(10)], "source string, zone string, date_order string").write.parquet(str(tmp_path / "source_clock.parquet"))
    got = sorted(((r.day, r.lines, r.sources) for r in core_queries()["topic_clusters"](spark, str(tmp_path)).collect()), key=str)
    assert got == [("2024-01-01", 1, 1), ("2024-01-02", 7, 7), (None, 2, 2)]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6))
    x[50] = x[10]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)] + [(900, None), (901, []), (902, [0.0] * 6)], "id long, v array<double>")
    got = {}
    for r in topk.exact_top_k(df.where("id % 20 = 0"), df.where("id < 900"), 4, blocks=3).orderBy("query_id", F.desc("similarity"), "id").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for q in range(0, 200, 20):
        assert got[q] == sorted((i for i in range(200) if i != q), key=lambda i: (-round(s[q, i], 12), i))[:4]


def test_segments_see_what_a_whole_source_would(spark):
    import random as rnd

    from pyspark.sql import Window

    r = rnd.Random(8)
    rows = [(r.choice(["a", "a", "b", None]), n, f"s{n % 3}", r.choice(["x", "", None, f"m{n}"]), r.random() < 0.3) for n in r.sample(range(100_000), 300)]
    df = spark.createDataFrame(rows, "source string, n long, sender string, text string, hit boolean")
    whole = Window.partitionBy("source").orderBy("n")
    line = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.concat("sender", F.lit(": "), F.trim("text")))
    want = {(x.source, x.n): x.c for x in df.withColumn("c", F.array_join(F.collect_list(line).over(whole.rowsBetween(-3, 3)), "\n")).collect()}
    got = scan.neighbours_text(df, "source", "n", "sender", "text").collect()
    assert len(got) == 300 and {(x.source, x.n): x.context for x in got} == want
    beside = df.withColumn("b", F.lag("hit").over(whole)).withColumn("a", F.lead("hit").over(whole)).where("hit or coalesce(a, false) or coalesce(b, false)")
    assert {x.n for x in scan.around_flagged(df, F.col("hit"), F.lit(True), "source", "n").collect()} == {x.n for x in beside.collect()}
    assert scan.neighbours_text(df.where("false"), "source", "n", "sender", "text").count() == 0


def test_overlaps_of_narrow_and_wide_intervals(spark):
    import random as rnd

    r = rnd.Random(6)
    rows = []
    for k in range(220):
        s = r.randint(-3000, 9000)
        rows.append((k, r.choice("ab"), s, s + r.choice([0, 1, r.randint(0, 60), r.randint(0, 900), 12_000])))
    df = spark.createDataFrame([*rows, (900, "a", 5, 1), (901, None, 0, 10)], "k long, g string, s long, e long")
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}
    got = [(p.a, p.b) for p in intervals.overlapping_pairs(df, "k", "g", "s", "e", 16).collect()]
    assert len(got) == len(set(got)) and set(got) == want
