"""Queries over intervals, sessions, series, vectors and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions.coerce import ratio, score_to_ten, trend_mark
from quaylight.operators import clusters, dedup, intervals, series, sessions
from quaylight.operators.scan import LOCAL_ZONE
from quaylight.operators.timestamps import normalize_times
from quaylight.plans.registry import query
from quaylight.sources.tables import table

_SEG = "(select distinct id, chat_id, date, start_msg_id, end_msg_id, score, status, mined_at, sent_at, sent_style from growth_segments)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Each segment once."""
    return table(spark, d, "growth_segments").select("id", "chat_id", "date", "start_msg_id", "end_msg_id", "score", "status", "mined_at", "sent_at", "sent_style").distinct()


@query("segments_by_chat", f"select chat_id, count(*) as days, min(date) as first_day, max(date) as last_day from {_SEG} group by 1")
def segments_by_chat(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("chat_id").agg(F.count("*").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("status_counts", f"select s as status, count(id) as n from (values ('pending'), ('sent'), ('rejected'), ('expired')) v(s) left join {_SEG} g on g.status = s group by 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each expected status, 0 included."""
    want = spark.createDataFrame([("pending",), ("sent",), ("rejected",), ("expired",)], "status string")
    return want.join(segments(spark, d).groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("latest_verdicts", """
with v as (select user_id, arg_max(event_type, event_id) as winner, max(event_id) as last_id, arg_max(ts, event_id) as last_ts from events group by 1)
select winner, count(*) as total, count(*) filter (last_ts >= timestamp '2024-01-23 00:00:00') as recent from v where winner in ('click', 'view') group by 1""")
def latest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, counted by type, all and recent."""
    v = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), "event_id").alias("r")).select("r.*")
    v = v.where(F.col("event_type").isin("click", "view"))
    return v.groupBy(F.col("event_type").alias("winner")).agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")).alias("recent"))


@query("sent_by_day", f"select substr(sent_at, 1, 10) as day, count(*) as n from {_SEG} where sent_at is not null group by 1")
def sent_by_day(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).where("sent_at is not null").groupBy(F.substring("sent_at", 1, 10).alias("day")).agg(F.count("*").alias("n"))


@query("next_segment", f"select id, score, date from {_SEG} where status = 'pending' order by (date = '2026-06-08') desc, score desc, id limit 1")
def next_segment(spark: SparkSession, d: str) -> DataFrame:
    """The best pending segment, the preferred day first."""
    return segments(spark, d).where("status = 'pending'").orderBy(F.desc(F.col("date") == "2026-06-08"), F.desc("score"), "id").limit(1).select("id", "score", "date")


@query("overlapping_segments", f"""
with g as {_SEG}, p as (select a.id as a, b.id as b, a.chat_id, greatest(0, least(a.end_msg_id, b.end_msg_id) - greatest(a.start_msg_id, b.start_msg_id) + 1) / least(a.end_msg_id - a.start_msg_id + 1, b.end_msg_id - b.start_msg_id + 1) as ratio
from g a join g b on a.chat_id = b.chat_id and a.id < b.id and a.start_msg_id <= b.end_msg_id and b.start_msg_id <= a.end_msg_id) select a, b, chat_id, round(ratio, 9) as ratio from p""")
def overlapping_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a chat that share messages, with the share of the narrower."""
    return intervals.overlapping_pairs(segments(spark, d), "id", "chat_id", "start_msg_id", "end_msg_id", 64).withColumn("ratio", F.round("ratio", 9))


@query("kept_segments")
def kept_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments kept when those that overlap an earlier one by half are left out."""
    return dedup.greedy_intervals(segments(spark, d), "chat_id", "start_msg_id", "end_msg_id", "id").select("id", "chat_id")


@query("segment_members", f"""
with g as {_SEG} select g.id as span_id, count(*) as messages, count(distinct c.channel) as channels from g join content_seen c on c.msg_id between g.start_msg_id and g.end_msg_id and cast(c.chat_id as bigint) - 1000100 = g.chat_id - 7000000 group by 1""")
def segment_members(spark: SparkSession, d: str) -> DataFrame:
    """Messages inside each segment."""
    pts = table(spark, d, "content_seen").select((F.col("chat_id").try_cast("bigint") - 1000100 + 7000000).alias("chat"), "msg_id", "channel")
    m = intervals.members(segments(spark, d), pts, "id", "chat_id", "start_msg_id", "end_msg_id", "chat", "msg_id", 64)
    return m.groupBy("span_id").agg(F.count("*").alias("messages"), F.count_distinct("channel").alias("channels"))


@query("top_senders", """
with c as (select distinct chunk_id, source_name, sender from chunks), n as (select source_name, sender, count(*) as k, min(chunk_id) as f from c where sender is not null group by 1, 2),
r as (select *, row_number() over (partition by source_name order by k desc, f) as rn from n where true) select source_name, string_agg(sender, ',' order by rn) as participants from r where rn <= 6 group by 1""")
def top_senders(spark: SparkSession, d: str) -> DataFrame:
    """The six busiest senders of a source, ties by first message."""
    c = table(spark, d, "chunks").select("chunk_id", "source_name", "sender").distinct().where("sender is not null")
    n = c.groupBy("source_name", "sender").agg(F.count("*").alias("k"), F.min("chunk_id").alias("f"))
    n = n.withColumn("rn", F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("k"), "f"))).where("rn <= 6")
    return n.groupBy("source_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sender"))), lambda s: s["sender"]), ",").alias("participants"))


@query("event_sessions", """
with o as (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
s as (select *, sum(case when ts - p <= interval 90 minutes then 0 else 1 end) over (partition by user_id order by ts, event_id) as session from o)
select user_id, cast(session as bigint) as session, count(*) as n, min(ts) as started, max(ts) as ended from s group by 1, 2""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user with at most 90 minutes between them."""
    s = sessions.numbered_sessions(table(spark, d, "events"), "user_id", F.col("ts"), F.col("ts"), ["ts", "event_id"], 90 * 60_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("merged_episodes", """
with i as (select event_id, user_id, ts as s, ts + to_microseconds(cast(floor(value * 60000000) as bigint)) as e from events where value > 0),
o as (select *, max(e) over (partition by user_id order by s, e, event_id rows between unbounded preceding and 1 preceding) as reach from i),
m as (select *, sum(case when s - reach <= interval 90 minutes then 0 else 1 end) over (partition by user_id order by s, e, event_id) as k from o),
a as (select user_id, k, min(s) as started, max(e) as ended, count(*) as parts from m group by 1, 2)
select user_id, arg_max(started, (ended - started, started)) as started, max(ended - started) = max(ended - started) as ok, arg_max(parts, (ended - started, started)) as parts from a group by 1""")
def merged_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The longest merged episode of each user, an event lasting ``value`` minutes."""
    e = table(spark, d, "events").where("value > 0").select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("value") * 60_000_000).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)"))).alias("e"))
    m = sessions.numbered_sessions(e, "user_id", F.col("s"), F.col("e"), ["s", "e", "event_id"], 90 * 60_000_000)
    a = m.groupBy("user_id", "session").agg(F.min("s").alias("started"), F.max("e").alias("ended"), F.count("*").alias("parts"))
    a = a.withColumn("long", F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp")))
    best = a.groupBy("user_id").agg(F.max_by(F.struct("started", "parts"), F.struct("long", "started")).alias("r"))
    return best.select("user_id", "r.started", F.lit(True).alias("ok"), "r.parts")


@query("albums_of_messages", """
with o as (select chat_id, msg_id, seq, coalesce(trim(channel), '') as txt, lag(msg_id) over w as pn, lag(seq) over w as ps from content_seen window w as (partition by chat_id order by msg_id)),
h as (select *, case when txt = '' and pn = msg_id - 1 and abs(seq - ps) <= 600 then null else msg_id end as head0 from o)
select chat_id, msg_id, last_value(head0 ignore nulls) over (partition by chat_id order by msg_id rows between unbounded preceding and current row) as head from h""")
def albums_of_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages without a channel's text joined to the one right before them in their chat, if near in time (here: of arrival)."""
    c = table(spark, d, "content_seen").select("chat_id", "msg_id", F.timestamp_seconds("seq").alias("ts"), F.col("channel").alias("txt"))
    return sessions.albums(c, "chat_id", "msg_id", "ts", "txt", 600).select("chat_id", "msg_id", "head")


@query("budgeted_chunks", """
with recursive d as (select distinct msg_id, producer, ts, text from delivered), o as (select producer, msg_id, length(text) as len, ts, row_number() over (partition by producer order by ts, msg_id) as n, ts - lag(ts) over (partition by producer order by ts, msg_id) as gap from d),
r as (select producer, n, 0 as chunk, len + 1 as used, msg_id, len from o where n = 1 union all
 select o.producer, o.n, case when r.used >= 18000 or (r.used >= 12000 and o.gap >= interval 10 minutes) then r.chunk + 1 else r.chunk end, case when r.used >= 18000 or (r.used >= 12000 and o.gap >= interval 10 minutes) then 0 else r.used end + o.len + 1, o.msg_id, o.len from r join o on o.producer = r.producer and o.n = r.n + 1)
select producer, cast(chunk as bigint) as chunk, count(*) as cards, cast(sum(len) as bigint) as chars, min(msg_id) as first_id from r group by 1, 2""")
def budgeted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a producer in chunks of about 12,000 characters, closed at gaps."""
    t = table(spark, d, "delivered").select("msg_id", "producer", "ts", "text").distinct()
    c = sessions.budget_chunks(t, "producer", "msg_id", "ts", F.length("text"), 12000)
    return c.groupBy("producer", "chunk").agg(F.count("*").alias("cards"), F.sum(F.length("text")).alias("chars"), F.min("msg_id").alias("first_id"))


@query("complete_day_totals", """
with e as (select user_id, cast(ts as date) as day, event_type, value, value <= 400 as ok from events)
select user_id, day, case when bool_and(ok) filter (event_type = 'purchase') then round(sum(value) filter (event_type = 'purchase'), 6) end as purchase, case when bool_and(ok) filter (event_type = 'view') then round(sum(value) filter (event_type = 'view'), 6) end as view from e group by 1, 2""")
def complete_day_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a day, null where any part is incomplete (here: out of range)."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    t = series.complete_totals(e, ["user_id", "day"], "event_type", ["purchase", "view"], "value", F.col("value") <= 400)
    return t.withColumn("purchase", F.round("purchase", 6)).withColumn("view", F.round("view", 6))


@query("trailing_medians", """
with a as (select distinct * from activity_days),
m as (select device_id, report_day, steps, resting_hr, median(steps) filter (steps > 0) over w as ms, count(steps) filter (steps > 0) over w as ns, median(resting_hr) filter (resting_hr > 0) over w as mh, count(resting_hr) filter (resting_hr > 0) over w as nh
 from a window w as (partition by device_id order by report_day range between interval 28 days preceding and interval 1 days preceding))
select device_id, report_day, case when ns >= 7 then round(ms, 6) end as steps_base, case when nh >= 7 then round(mh, 6) end as hr_base,
 case when ns >= 7 and ms > 0 and steps is not null then case when steps / ms >= 1.2 then '↑' when steps / ms <= 0.8 then '↓' else '=' end else '–' end as steps_mark from m""")
def trailing_medians(spark: SparkSession, d: str) -> DataFrame:
    """Baselines of four weeks and how a day compares."""
    a = table(spark, d, "activity_days").distinct()
    a = a.withColumn("sb", series.trailing_median(a, "device_id", "report_day", F.col("steps"))).withColumn("hb", series.trailing_median(a, "device_id", "report_day", F.col("resting_hr")))
    return a.select("device_id", "report_day", F.round("sb", 6).alias("steps_base"), F.round("hb", 6).alias("hr_base"), trend_mark(ratio(F.col("steps"), F.col("sb"))).alias("steps_mark"))


@query("json_leaves_of_events", """select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where json_extract(props, '$.k') is not null""")
def json_leaves_of_events(spark: SparkSession, d: str) -> DataFrame:
    """A number out of the JSON of an event."""
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).where("k is not null")


@query("scores_coerced", f"select id, case when score is null or isnan(score) or score < 0 or score > 10 then 0.0 else score end as score from {_SEG}")
def scores_coerced(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("id", score_to_ten(F.col("score")).alias("score"))


@query("similar_vectors", """
with q as (select vec_id as qid, embedding::double[] as qe from embeddings where vec_id % 20 = 0),
s as (select qid, vec_id, list_cosine_similarity(qe, embedding::double[]) as sim from q join embeddings on vec_id <> qid),
r as (select *, row_number() over (partition by qid order by sim desc, vec_id) as rn from s) select qid, vec_id, round(sim, 6) as sim from r where rn <= 5""")
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every twentieth one, exact: the queries pass all vectors in blocks.

    Each block keeps its best five of every query before the shuffle.
    """
    from quaylight.operators.topk import exact_top_k

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return exact_top_k(e.where("id % 20 = 0"), e, 5).select(F.col("query_id").alias("qid"), F.col("id").alias("vec_id"), F.round("similarity", 6).alias("sim"))


@query("similar_recent_cards", """
with d as (select distinct msg_id, ts, producer, embedding from delivered where len(embedding) = 48 and list_aggregate(list_transform(embedding, lambda x: isfinite(x)), 'bool_and') and list_aggregate(list_transform(embedding, lambda x: x <> 0), 'bool_or') and producer not in ('growth', 'daily_summary')),
p as (select b.msg_id as new_id, a.msg_id as old_id, list_cosine_similarity(a.embedding, b.embedding) as sim from d a join d b on (b.ts > a.ts or (b.ts = a.ts and b.msg_id > a.msg_id)) and epoch_us(b.ts) - epoch_us(a.ts) < 172800000000),
r as (select *, row_number() over (partition by new_id order by sim desc, old_id) as rn from p where sim >= 0.8) select new_id, old_id, round(sim, 6) as sim, case when sim >= 0.93 then 'annotate' else 'ask' end as decision from r where rn <= 3""")
def similar_recent_cards(spark: SparkSession, d: str) -> DataFrame:
    """For each card up to three alike of the 48 hours before it, some producers left out, with what follows from it."""
    from quaylight.operators.topk import recent_alike

    c = table(spark, d, "delivered").select("msg_id", "ts", "producer", "embedding").where(~F.col("producer").isin("growth", "daily_summary") & (F.size("embedding") == 48))
    good = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    c = c.where(good).select(F.col("msg_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("embedding").cast("array<double>").alias("v"), "producer").distinct()
    p = recent_alike(c.drop("producer"), 48 * 3600 * 1_000_000, 3, 0.8)
    return p.select("new_id", "old_id", F.round("similarity", 6).alias("sim"), F.when(F.col("similarity") >= 0.93, "annotate").otherwise("ask").alias("decision"))


@query("band_histogram", """
with e as (select distinct msg_id, ts, producer from delivered), p as (select epoch_us(b.ts) - epoch_us(a.ts) as gap, a.producer <> b.producer as other from e a join e b on (b.ts > a.ts or (b.ts = a.ts and b.msg_id > a.msg_id)) and epoch_us(b.ts) - epoch_us(a.ts) < 172800000000)
select cast(gap // 3600000000 as bigint) as hours, count(*) as pairs, count(*) filter (other) as cross_producer from p group by 1""")
def band_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cards within two days by the hours between them."""
    c = table(spark, d, "delivered").select("msg_id", "ts", "producer").distinct()
    p = intervals.band_pairs(c, "msg_id", "ts", 48 * 3600 * 1_000_000, ["producer"])
    return p.groupBy(F.expr("(b_us - a_us) div 3600000000").alias("hours")).agg(F.count("*").alias("pairs"), F.count_if(F.col("a_producer") != F.col("b_producer")).alias("cross_producer"))


@query("sampled_by_band", """
with e as (select event_id, cast(floor(value / 20) as bigint) as band, md5(cast(event_id as varchar)) as h from events), r as (select *, row_number() over (partition by band order by h) as rn from e) select event_id, band from r where rn <= 8""")
def sampled_by_band(spark: SparkSession, d: str) -> DataFrame:
    """Eight events of each band of values, drawn by hash: the sampling is the feature."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("value") / 20).alias("band"), F.md5(F.col("event_id").cast("string")).alias("h"))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("band").orderBy("h"))).where("rn <= 8").select("event_id", "band")


@query("sender_by_producer", """
select thread_id, count(*) filter (producer = 'chatdaily_raw') as raw, count(*) filter (producer = 'x_monitor') as monitor, count(*) filter (producer = 'other') as other, round(count(*) filter (producer = 'other') / count(*), 6) as other_share from (select distinct msg_id, thread_id, producer from delivered) group by 1""")
def sender_by_producer(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a thread by producer."""
    c = table(spark, d, "delivered").select("msg_id", "thread_id", "producer").distinct()
    n = lambda p: F.count_if(F.col("producer") == p)
    return c.groupBy("thread_id").agg(n("chatdaily_raw").alias("raw"), n("x_monitor").alias("monitor"), n("other").alias("other"), F.round(n("other") / F.count("*"), 6).alias("other_share"))


@query("local_day_counts", """select event_type as layer, cast(ts + interval 8 hours as date) as local_day, count(*) as n from events where event_type <> 'signup' group by 1, 2""")
def local_day_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by local calendar day."""
    e = table(spark, d, "events").where("event_type <> 'signup'")
    return e.groupBy(F.col("event_type").alias("layer"), F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")).alias("local_day")).agg(F.count("*").alias("n"))


@query("topic_clusters")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one local day that several sources report, clustered in order; lines whose time names no instant are a group with a null day."""
    c = table(spark, d, "media_candidates").select("seq", "group_name", "context", "timestamp").where("length(context) between 15 and 120")
    c = normalize_times(c, "timestamp", "group_name", table(spark, d, "source_clock"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros("utc_us"), LOCAL_ZONE)).cast("string")
    c = c.select("seq", "group_name", "context", day.alias("day"))
    return clusters.clustered(c, "day", "group_name", "seq", "context")


@query("key_overlap_by_channel", """
with h as (select fingerprint, min(epoch_us(t)) as at from (select fingerprint, batch_no, timestamp '2024-01-01' + to_days(cast(batch_no as int)) as t from content_seen where fingerprint is not null) where batch_no < 10 group by 1)
select channel, count(*) as n, count(h.fingerprint) as hits, count(*) filter (h.fingerprint is not null and (c.batch_no - 0) - (h.at - epoch_us(timestamp '2024-01-01')) / 86400000000 <= 15) as near from content_seen c left join h on h.fingerprint = c.fingerprint where c.batch_no >= 10 group by 1""")
def key_overlap_by_channel(spark: SparkSession, d: str) -> DataFrame:
    """Rows of later batches whose fingerprint came in an early one, all and those not long after, by channel."""
    c = table(spark, d, "content_seen").select("fingerprint", "batch_no", "channel")
    h = c.where("batch_no < 10 and fingerprint is not null").groupBy("fingerprint").agg(F.min("batch_no").alias("first_batch"))
    j = c.where("batch_no >= 10").join(h, "fingerprint", "left")
    return j.groupBy("channel").agg(F.count("*").alias("n"), F.count("first_batch").alias("hits"), F.count_if(F.col("batch_no") - F.col("first_batch") <= 15).alias("near"))
