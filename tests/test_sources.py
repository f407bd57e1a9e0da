"""Sources over small landed files."""

import json

from pyspark.sql import functions as F

from quaylight.sources import device, exports, feeds, jsonl


def test_exports(spark, tmp_path):
    (tmp_path / "g1.md").write_text("# g\n[Telegram / g / 10:01 / a] hi [x] there\n[Telegram / g / 10:02 / b]  \n\n### 2025-01-01 09:00\n\n**c**: first\n**d**: [图片] local_id=7 [视频] local_id=8\n### 2025-01-01 09:30\r\n**c**: last\n", encoding="utf-8")
    df = exports.read_exports(spark, str(tmp_path))
    assert [r.source for r in df.collect()] == ["g1"]
    assert [(r.group_name, r.time, r.sender, r.message) for r in exports.tagged_messages(df, "source", "text").collect()] == [("g", "10:01", "a", "hi [x] there")]
    assert [(r.time, r.sender, r.message) for r in exports.headed_messages(df, "source", "text").orderBy("line_no").collect()] == [("09:00", "c", "first"), ("09:00", "d", "[图片] local_id=7 [视频] local_id=8"), ("09:30", "c", "last")]
    assert {(r.media_type, r.media_id) for r in exports.media_candidates(df, "source", "text").collect()} == {("图片", 7), ("视频", 8)}


def test_feeds(spark, tmp_path):
    atom = """<feed><entry><yt:videoId>v1</yt:videoId><title> T </title><published>2024-05-01T00:00:00+00:00</published><author><name>n</name></author>
    <media:group><media:description>d</media:description><media:thumbnail url="http://i"/><media:community><media:statistics views="5"/></media:community></media:group></entry><entry><title>no id</title></entry></feed>"""
    (tmp_path / "f.xml").write_text(atom)
    v = feeds.read_atom(spark, str(tmp_path / "f.xml")).collect()
    assert [(r.item_id, r.title, r.author, r.cover, r.views) for r in v] == [("v1", "T", "n", "http://i", 5)]
    page = {"list": [{"bv_id": "BV1", "title": "a", "pubtime": "1704067200", "duration": "PT2M", "upper": {"name": "n"}, "cnt_info": {"play": 3}}, {"id": 9, "title": "art", "pubtime": "1704067200000", "image_urls": ["", "c"]}, {"id": 10, "title": " "}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    items = feeds.read_items(spark, str(tmp_path / "p.json"))
    got = {r.item_id: (r.kind, r.seconds, r.cover, r.published_at is None) for r in items.collect()}
    assert got == {"BV1": ("video", 120, None, False), "9": ("article", None, "c", True)}
    seen = spark.createDataFrame([("9",)], "item_id string")
    assert [r.item_id for r in feeds.unseen_since(items, seen, F.lit("2023-01-01").cast("timestamp")).collect()] == ["BV1"]
    assert feeds.unseen_since(items, seen, F.lit("2025-01-01").cast("timestamp")).count() == 0
    both = feeds.united(items, feeds.read_atom(spark, str(tmp_path / "f.xml")))
    assert both.count() == 3
    det = spark.createDataFrame([("v1", 77)], "item_id string, seconds long")
    assert {r.item_id: r.seconds for r in feeds.enriched(both, det).collect()} == {"BV1": 120, "9": None, "v1": 77}


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\nbroken\n\n{"id": 1, "v": "y"}\n{"id": 2}\n')
    rows = jsonl.read_lines(spark, str(tmp_path / "a.jsonl"), "id long, v string")
    from quaylight.operators.dedup import last_wins

    assert {(r.id, r.v) for r in last_wins(rows.select("id", "v", "line_no"), ["id"], ["line_no"]).collect()} == {(1, "y"), (2, None)}
    assert tuple(jsonl.bad_lines(spark, str(tmp_path / "a.jsonl")).first()) == (4, 1)
    jsonl.append_lines(rows.select("id", "v"), str(tmp_path / "out"), ["id", "v"])
    jsonl.append_lines(rows.select("id", "v"), str(tmp_path / "out"), ["id", "v"])
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    (tmp_path / "ix.json").write_text(json.dumps({"entries": {"t:1": {"ts": "2030-01-01T00:00:00+00:00", "by": "m"}, "t:2": {"ts": "2001-01-01T00:00:00+00:00", "by": "m"}}}))
    assert [r.key for r in jsonl.fresh_index(spark, str(tmp_path / "ix.json"), "2030-01-02 00:00:00", max_age_hours=10**6).collect()] == ["t:1"]
    assert jsonl.fresh_index(spark, str(tmp_path / "ix.json"), "2130-01-02 00:00:00").count() == 0


def test_device_records(spark, tmp_path):
    rec = lambda m, s, e, u, q, st=None: {"metric": m, "start": s, "end": e, "unit": u, "qty": q, "stage": st}
    day = 8766 * 86400.0 - 978307200 + 0  # 1994-01-01
    rows = [rec("step_count", day, day + 60, "count", 10.0), rec("step_count", day, day + 60, "count", 12.0), rec("step_count", day + 100, day + 160, "count", 5.0), rec("heart_rate_variability", day, day, "ms", 40.0), rec("step_count", day, day + 9, "km", 99.0)]
    (tmp_path / "1994-01-01.json").write_text("\n".join(map(json.dumps, rows)))
    r = device.distinct_records(device.read_records(spark, str(tmp_path)))
    assert r.count() == 4 and r.where("complete").count() == 4
    a = device.activity_days(r, "UTC").collect()
    assert len(a) == 1 and a[0].step_count in (15.0, 17.0) and a[0].heart_rate_variability == 40.0 and a[0].active_energy is None
    part = r.withColumn("complete", F.lit(False))
    assert device.activity_days(part, "UTC").first().step_count is None


def test_sleep(spark):
    h = lambda x: f"2024-01-02 {int(x):02}:{int(x % 1 * 60):02}:00"
    rows = [("p", h(0), h(3), "core"), ("p", h(3.5), h(5), "deep"), ("p", h(4), h(4.5), "awake"), ("p", h(6.5), h(7), "rem"), ("p", h(13), h(14), "core"), ("p", h(16), h(16), "core")]
    df = spark.createDataFrame(rows, "who string, s string, e string, stage string").selectExpr("who", "cast(s as timestamp) s", "cast(e as timestamp) e", "stage")
    ep = device.sleep_episodes(df, "who", "s", "e", "stage")
    got = ep.collect()
    assert len(got) == 1 and got[0].asleep == 5.0 and got[0].awake == 0.5 and got[0].ended.hour == 7
    assert device.longest_by_day(ep, "who").count() == 1
