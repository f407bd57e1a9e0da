"""Queries over messages, cards, exports and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions import coerce, identity, markup
from quaylight.operators import dedup, scan, sessions, state
from quaylight.plans.registry import query
from quaylight.sources import exports
from quaylight.sources.tables import table

_MD = r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)"
_BARE = identity.BARE_LINK
_JUNK = identity.NOT_SUBSTANCE


def _q(s: str) -> str:
    """A string literal of SQL."""
    return "'" + s.replace("'", "''") + "'"


_BODY = f"regexp_replace(regexp_replace(text, {_q(_MD)}, '\\1', 'g'), {_q(_BARE)}, ' ', 'g')"


@query("scan_newest_in_window", """
with w as (select event_id, ts, user_id, event_type from events where ts >= timestamp '2024-01-09 16:00:00' and ts < timestamp '2024-01-19 16:00:00')
select * from (select * from w order by ts desc, event_id desc limit 400)""")
def scan_newest_in_window(spark: SparkSession, d: str) -> DataFrame:
    """The 400 latest events of ten local days."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return scan.newest_in_window(e, "ts", "2024-01-10", "2024-01-20", 400, "event_id")


@query("scan_oldest_after_mark", "select event_id, ts, user_id, event_type from events where event_id > 300 order by event_id limit 400")
def scan_oldest_after_mark(spark: SparkSession, d: str) -> DataFrame:
    """The 400 first events above a mark."""
    return scan.oldest_after_mark(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), "event_id", 300, 400)


@query("marks_by_chat", "select cast(chat_id as bigint) as chat_id, max(msg_id) as max_msg_id from content_seen where regexp_full_match(chat_id, '-?[0-9]+') group by 1")
def marks_by_chat(spark: SparkSession, d: str) -> DataFrame:
    """High-water mark of each chat from its seen keys."""
    keys = table(spark, d, "content_seen").select(F.concat_ws(":", "chat_id", "msg_id").alias("key"))
    return scan.high_marks(keys.unionByName(spark.createDataFrame([("note:abc",), ("x",)], "key string")), "key")


@query("rows_above_marks", """
with m as (select chat_id as c, max(msg_id) as top from content_seen where batch_no < 20 group by 1)
select seq, chat_id, msg_id from content_seen left join m on chat_id = c where top is null or msg_id > top""")
def rows_above_marks(spark: SparkSession, d: str) -> DataFrame:
    """Messages above the mark that the first 20 batches left."""
    c = table(spark, d, "content_seen").select("seq", "batch_no", "chat_id", "msg_id")
    marks = c.where("batch_no < 20").groupBy("chat_id").agg(F.max("msg_id").alias("max_msg_id"))
    return scan.above_marks(c, marks, "chat_id", "msg_id").select("seq", "chat_id", "msg_id")


@query("unseen_messages", "select seq, chat_id, msg_id from content_seen a where batch_no >= 20 and not exists (select 1 from content_seen b where b.batch_no < 20 and b.chat_id = a.chat_id and b.msg_id = a.msg_id)")
def unseen_messages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of later batches whose message wasn't seen in earlier ones."""
    c = table(spark, d, "content_seen").select("seq", "batch_no", "chat_id", "msg_id")
    return c.where("batch_no >= 20").join(c.where("batch_no < 20"), ["chat_id", "msg_id"], "left_anti").select("seq", "chat_id", "msg_id")


@query("low_content_by_source", r"""
select source_name, count(*) as messages, count(*) filter (length(trim(text)) <= 2 or regexp_full_match(trim(text), '[^\p{L}\p{N}]{1,8}')) as low from chunks group by 1""")
def low_content_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How many messages of a source say next to nothing."""
    return table(spark, d, "chunks").groupBy("source_name").agg(F.count("*").alias("messages"), F.count_if(markup.is_low_content(F.col("text"))).alias("low"))


@query("rendered_lines", r"""
select chunk_id, '[Telegram / ' || source_name || ' / ' || time || ' / ' || coalesce(sender, 'unknown') || '] ' || trim(text) as line
from (select distinct chunk_id, source_name, time, sender, text from chunks) where not (length(trim(text)) <= 2 or regexp_full_match(trim(text), '[^\p{L}\p{N}]{1,8}'))""")
def rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tagged lines of the messages worth keeping."""
    c = table(spark, d, "chunks").select("chunk_id", "source_name", "time", "sender", "text").distinct().where(~markup.is_low_content(F.col("text")))
    return c.select("chunk_id", exports.rendered(F.col("source_name"), F.col("time"), F.col("sender"), F.col("text")).alias("line"))


@query("claims_and_neighbours", """
with c as (select distinct chunk_id, source_name, text from chunks),
f as (select *, (list_aggregate(list_transform([%s], lambda w: contains(text, w)), 'bool_or') or regexp_matches(text, '\\d+(?:\\.\\d+)+')) as claim,
 (not (regexp_replace(text, '\\s+', '', 'g') = '' or lower(regexp_replace(text, '\\s+', '', 'g')) in (%s) or regexp_full_match(regexp_replace(text, '\\s+', '', 'g'), '[哈啊嘿呵hH]+'))
  and list_aggregate(list_transform([%s], lambda w: contains(text, w)), 'bool_or')) as ctx from c),
n as (select *, lag(claim) over w as b, lead(claim) over w as a from f window w as (partition by source_name order by chunk_id))
select chunk_id, source_name, claim from n where claim or (ctx and (coalesce(b, false) or coalesce(a, false)))""" % tuple(", ".join(map(_q, x)) for x in (markup.CLAIM_WORDS, markup.LOW_WORDS, markup.CONTEXT_WORDS)))  # fmt: skip
def claims_and_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Messages that claim something, and talk about it right beside them."""
    c = table(spark, d, "chunks").select("chunk_id", "source_name", "text").distinct()
    c = c.withColumn("claim", markup.is_claim(F.col("text")))
    return scan.around_flagged(c, F.col("claim"), markup.is_context(F.col("text")), "source_name", "chunk_id").select("chunk_id", "source_name", "claim")


@query("context_of_messages", """
with c as (select distinct chunk_id, source_name, sender, text from chunks)
select chunk_id, string_agg(case when trim(text) <> '' then coalesce(sender, 'unknown') || ': ' || trim(text) end, chr(10)) over (partition by source_name order by chunk_id rows between 3 preceding and 3 following) as context from c""")
def context_of_messages(spark: SparkSession, d: str) -> DataFrame:
    """Each message with the three before and after it."""
    c = table(spark, d, "chunks").select("chunk_id", "source_name", "sender", "text").distinct()
    return scan.neighbours_text(c, "source_name", "chunk_id", "sender", "text").select("chunk_id", "context")


@query("producers_of_cards", r"""
with c as (select distinct msg_id, left(ltrim(text), 400) as t from delivered)
select case when regexp_matches(t, '^[⚠🚨✅]') then 'alert' when regexp_matches(t, '^📢 .+? · [0-2]?\d:[0-5]\d') then 'chatdaily_raw' when regexp_matches(t, '^(?:📢 ?@\S+|📄 .*published)') then 'x_monitor'
 when regexp_matches(t, '^🌱') then 'growth' when regexp_matches(t, '(?m)^👤 .+') then 'bilibili' when regexp_matches(t, '(?m)^(?:#{0,4}\s*)?(?:📋|🌤|.{0,24}(?:日报|晨报))') then 'daily_summary' when regexp_matches(t, '(?i)macrumors') then 'macrumors' else 'other' end as guessed, count(*) as cards from c group by 1""")
def producers_of_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards by the producer that their shape shows."""
    return table(spark, d, "delivered").select("msg_id", "text").distinct().groupBy(markup.producer(F.col("text")).alias("guessed")).agg(F.count("*").alias("cards"))


@query("fingerprint_groups", f"""
with b as (select doc_id, regexp_replace(lower({_BODY}), {_q(_JUNK)}, '', 'g') as body from documents where text is not null)
select sha1(body) as fingerprint, count(*) as copies, min(doc_id) as owner from b where length(body) >= 24 group by 1 having count(*) > 1""")
def fingerprint_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once, with their first document."""
    t = table(spark, d, "documents").select("doc_id", identity.text_fingerprint(F.col("text")).alias("fingerprint"))
    return dedup.first_owner(t, "fingerprint", ["doc_id"]).where("copies > 1").select("fingerprint", "copies", F.col("doc_id").alias("owner"))


@query("first_owner_of_keys", "select fingerprint, min(seq) as seq, count(*) as copies from content_seen where fingerprint is not null group by 1")
def first_owner_of_keys(spark: SparkSession, d: str) -> DataFrame:
    """Who came first with each fingerprint as it is written."""
    return dedup.first_owner(table(spark, d, "content_seen").select("fingerprint", "seq"), "fingerprint", ["seq"])


@query("last_of_message", "select chat_id, msg_id, max(seq) as seq, arg_max(batch_no, seq) as batch_no from content_seen group by 1, 2")
def last_of_message(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each message."""
    return dedup.last_wins(table(spark, d, "content_seen").select("chat_id", "msg_id", "seq", "batch_no"), ["chat_id", "msg_id"], ["seq"])


@query("owners_in_rolling_window", """
with recursive e as (select concat_ws(':', user_id, event_type) as key, ts, event_id, row_number() over (partition by concat_ws(':', user_id, event_type) order by ts, event_id) as n from events where ts is not null),
a as (select key, ts, event_id, n from e where n = 1 union all
 select key, ts, event_id, n from (select e.*, row_number() over (partition by e.key order by e.n) as r from a join e on e.key = a.key and e.ts >= a.ts + interval 2 hours) where r = 1)
select e.key, e.ts, e.event_id, a.event_id as owner from e asof join a on e.key = a.key and e.n >= a.n""")
def owners_in_rolling_window(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the event of its user and type that opened the two-hour window it falls in."""
    e = table(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "ts", "event_id")
    return dedup.rolling_owners(e, "key", "ts", "event_id", 2 / 24)


@query("bare_link_posts", f"""
select doc_id from documents where regexp_matches(text, {_q(_BARE)}) and length(regexp_replace({_BODY}, {_q(_JUNK)}, '', 'g')) <= 10""")
def bare_link_posts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are hardly more than a link."""
    return table(spark, d, "documents").where(identity.is_bare_link(F.col("text"))).select("doc_id")


@query("links_by_target")
def links_by_target(spark: SparkSession, d: str) -> DataFrame:
    """Canonical links of documents with the number of documents that carry them."""
    t = table(spark, d, "documents").where("text like '%http%'")
    return t.select("doc_id", F.explode(identity.link_keys_col(F.col("text"))).alias("link")).groupBy("link").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("known_keys_of_documents")
def known_keys_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Keys (text and links) by which documents are known, with their first document."""
    t = table(spark, d, "documents").select("doc_id", F.explode(identity.seen_keys_col(F.col("text"))).alias("key"))
    return dedup.first_owner(t, "key", ["doc_id"]).select("key", F.col("doc_id").alias("owner"), "copies")


@query("card_bodies", r"""
with d as (select distinct msg_id, regexp_replace(coalesce(text, ''), '^[\s\pZ\x0b\x1c-\x1f\x{85}]+|[\s\pZ\x0b\x1c-\x1f\x{85}]+$', '', 'g') as t from delivered),
h as (select msg_id, regexp_replace(regexp_replace(t, '^(?:📢|📄|🌱|📋|🔁|⚠|🚨|✅)[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*', ''), '(^|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])[ \t\x{a0}\x{3000}]*👤 [^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*[^\s\pZ][^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*', '\1', 'g') as t from d),
u as (select msg_id, regexp_replace(regexp_replace(t, '\[([^\]\n]+)\]\((https?://[^)\s\pZ]+)\)', '\1', 'g'), 'https?://[^\s\pZ\x0b\x1c-\x1f\x{85}]+', ' ', 'g') as t from h),
c as (select msg_id, regexp_replace(regexp_replace(t, '(^|\PN)[0-2]?[0-9]:[0-5][0-9](\PN|$)', '\1 \2', 'g'), '(^|\PN)[0-2]?[0-9]:[0-5][0-9](\PN|$)', '\1 \2', 'g') as t from u)
select msg_id, left(trim(regexp_replace(t, '[\s\pZ\x0b\x1c-\x1f\x{85}]+', ' ', 'g')), 1500) as body from c""")
def card_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Cards without header, links and clock times."""
    from quaylight.functions.text import card_body_col

    return table(spark, d, "delivered").select("msg_id", "text").distinct().select("msg_id", card_body_col(F.col("text")).alias("body"))


@query("entries_folded", r"""
with l as (select distinct * from hot_leads),
f as (select *, sha256('title:' || regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g') || '|' || regexp_replace(lower(category), '[^\p{L}\p{N}]', '', 'g')) as fingerprint from l)
select fingerprint, arg_min(id, (captured_at, id)) as id, min(captured_at) as captured_at,
 coalesce(arg_max(source_group, (captured_at, id)) filter (trim(source_group) <> ''), null) as source_group, arg_max(source_sender, (captured_at, id)) filter (trim(source_sender) <> '') as source_sender, count(*) as mention_count
from f group by 1""")
def entries_folded(spark: SparkSession, d: str) -> DataFrame:
    """Leads folded by identity: first id and day, latest non-empty source, number of mentions."""
    t = table(spark, d, "hot_leads").distinct()
    t = t.withColumn("fingerprint", identity.entry_fingerprint(F.col("title"), F.lit(None).cast("string"), F.col("category")))
    return state.folded_mentions(t, "fingerprint", ["captured_at", "id"], ["source_group", "source_sender"], ["id", "captured_at"])


@query("topics_folded", """
with e as (select event_type || ' ' || (user_id % 20) as title, cast(ts as date) as day, event_id from events)
select substr(sha256(regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g')), 1, 12) as topic_id, count(distinct day) as mention_count, max(day) as last_seen, list_sort(list(distinct day)) as seen_dates from e group by 1""")
def topics_folded(spark: SparkSession, d: str) -> DataFrame:
    """Topics with the days on which they came up: a day counts once."""
    e = table(spark, d, "events").select(identity.topic_id(F.concat(F.col("event_type"), F.lit(" "), F.col("user_id") % 20)).alias("topic_id"), F.to_date("ts").alias("day"))
    return e.groupBy("topic_id").agg(F.count_distinct("day").alias("mention_count"), F.max("day").alias("last_seen"), F.array_sort(F.collect_set("day")).alias("seen_dates"))


@query("topic_streaks", """
with d as (select distinct user_id, cast(ts as date) as day from events),
g as (select user_id, day, row_number() over (partition by user_id order by day desc) as n, max(day) over (partition by user_id) as top from d)
select user_id, max(day) as last_day, count(*) as streak from g where day = top - cast(n - 1 as int) group by 1""")
def topic_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive days of a user up to the latest one."""
    return sessions.day_streaks(table(spark, d, "events"), "user_id", F.to_date("ts"))


@query("recent_topics", """
with t as (select user_id, max(cast(ts as date)) as last_seen, count(distinct cast(ts as date)) as days from events group by 1)
select user_id, last_seen, case when days >= 2 then 'repeat' else 'seen_once' end as marker from t where date '2024-01-31' - last_seen <= 7""")
def recent_topics(spark: SparkSession, d: str) -> DataFrame:
    """Users seen within the cooldown of seven days."""
    t = table(spark, d, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last_seen"), F.count_distinct(F.to_date("ts")).alias("days"))
    return t.where(F.datediff(F.lit("2024-01-31").cast("date"), "last_seen") <= 7).select("user_id", "last_seen", F.when(F.col("days") >= 2, "repeat").otherwise("seen_once").alias("marker"))


@query("retained_cards", "select msg_id from (select distinct msg_id, ts from delivered) where ts >= (select max(ts) from delivered) - interval 14 days")
def retained_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of the last 14 days before the latest."""
    t = table(spark, d, "delivered").select("msg_id", "ts").distinct()
    return state.pruned(t, "ts", table(spark, d, "delivered").agg(F.max("ts")).scalar(), 14).select("msg_id")


@query("finalized_videos", """
with f as (select bvid, min(seq) as seq from bili_videos where bvid is not null group by 1)
select bvid, v.seq, view, title from f join bili_videos v using (seq, bvid) order by view desc, seq limit 50""")
def finalized_videos(spark: SparkSession, d: str) -> DataFrame:
    """First of each id, most seen first, at most 50."""
    return dedup.finalized(table(spark, d, "bili_videos").select("bvid", "seq", "view", "title"), "bvid", "seq", "view", 50)


@query("durations_of_videos", r"""
with p as (select duration, coalesce(try_cast(nullif(regexp_extract(duration, '^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$', 1), '') as bigint), 0) as h, coalesce(try_cast(nullif(regexp_extract(duration, '^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$', 2), '') as bigint), 0) as m,
 coalesce(try_cast(nullif(regexp_extract(duration, '^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$', 3), '') as bigint), 0) as s, regexp_full_match(duration, '(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?') and regexp_matches(duration, '\d') as ok from bili_videos)
select case when ok then h * 3600 + m * 60 + s end as seconds, count(*) as videos from p group by 1""")
def durations_of_videos(spark: SparkSession, d: str) -> DataFrame:
    """Videos by length in seconds."""
    return table(spark, d, "bili_videos").groupBy(coerce.clock_duration_seconds(F.col("duration")).alias("seconds")).agg(F.count("*").alias("videos"))


@query("tagged_export_lines", r"""
with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) as raw, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) - 1 as line_no from documents where text is not null),
t as (select doc_id, line_no, trim(raw) as line from l)
select doc_id, cast(line_no as int) as line_no, trim(regexp_extract(line, '^\[Telegram / (.+?) / (\d{2}:\d{2}) / (.+?)\] (.*)$', 1)) as group_name, trim(regexp_extract(line, '^\[Telegram / (.+?) / (\d{2}:\d{2}) / (.+?)\] (.*)$', 2)) as time,
 trim(regexp_extract(line, '^\[Telegram / (.+?) / (\d{2}:\d{2}) / (.+?)\] (.*)$', 3)) as sender, trim(regexp_extract(line, '^\[Telegram / (.+?) / (\d{2}:\d{2}) / (.+?)\] (.*)$', 4)) as message
from t where regexp_matches(line, '^\[Telegram / (.+?) / (\d{2}:\d{2}) / (.+?)\] (.*)$') and trim(regexp_extract(line, '^\[Telegram / (.+?) / (\d{2}:\d{2}) / (.+?)\] (.*)$', 4)) <> ''""")
def tagged_export_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages of exports whose lines carry their time."""
    return exports.tagged_messages(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query("headed_export_lines", r"""
with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) as raw, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) - 1 as line_no from documents where text is not null),
t as (select doc_id, line_no, trim(raw) as line from l),
f as (select *, last_value(case when regexp_matches(line, '^### \d{4}-\d{2}-\d{2} (\d{2}:\d{2})$') then regexp_extract(line, '^### \d{4}-\d{2}-\d{2} (\d{2}:\d{2})$', 1) end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as tm from t)
select doc_id, cast(line_no as int) as line_no, coalesce(tm, '') as time, trim(regexp_extract(line, '^\*\*([^*]+)\*\*:\s*(.*)$', 1)) as sender, trim(regexp_extract(line, '^\*\*([^*]+)\*\*:\s*(.*)$', 2)) as message
from f where regexp_matches(line, '^\*\*([^*]+)\*\*:\s*(.*)$') and trim(regexp_extract(line, '^\*\*([^*]+)\*\*:\s*(.*)$', 2)) <> ''""")
def headed_export_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages of exports whose times stand in headers."""
    return exports.headed_messages(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query("attachments_in_exports", r"""
with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) as raw, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) - 1 as line_no from documents where text like '%local_id=%'),
t as (select doc_id, line_no, trim(raw) as line from l),
f as (select *, last_value(case when regexp_matches(line, '^### \d{4}-\d{2}-\d{2} (\d{2}:\d{2})$') then regexp_extract(line, '^### \d{4}-\d{2}-\d{2} (\d{2}:\d{2})$', 1) end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as tm from t),
m as (select doc_id, line_no, coalesce(tm, '') as time, trim(regexp_extract(line, '^\*\*([^*]+)\*\*:\s*(.*)$', 1)) as sender, trim(regexp_extract(line, '^\*\*([^*]+)\*\*:\s*(.*)$', 2)) as message from f where regexp_matches(line, '^\*\*([^*]+)\*\*:\s*(.*)$'))
select doc_id, cast(line_no as int) as line_no, time, sender, unnest(regexp_extract_all(message, '\[(图片|视频|文件|语音)\]\s*local_id=(\d+)', 1)) as media_type, cast(unnest(regexp_extract_all(message, '\[(图片|视频|文件|语音)\]\s*local_id=(\d+)', 2)) as bigint) as media_id from m where message <> ''""")
def attachments_in_exports(spark: SparkSession, d: str) -> DataFrame:
    """Attachments that messages of exports name."""
    return exports.media_candidates(table(spark, d, "documents").where("text like '%local_id=%'"), "doc_id", "text")


@query("cleaned_exports", r"""
with c as (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(?m)^### \d{4}-\d{2}-\d{2} \d{2}:\d{2}\n\n\[链接\][^\n]*拍了拍[^\n]*\n\n?', '', 'g'), '(?m)^### \d{4}-\d{2}-\d{2} \d{2}:\d{2}\n\n\[系统\][^\n]*\n\n?', '', 'g'),
 '\[(?:图片|视频|文件|语音|位置|动画表情|音乐|小程序|链接卡片)\]\s*local_id=\d+', '', 'g'), '\[[A-Za-z0-9一-鿿]{1,10}\]', '', 'g'), '(?m)^### \d{4}-\d{2}-\d{2} \d{2}:\d{2}\n\n\*\*[^*]+\*\*:\s*\n\n?', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as cleaned from documents where kind = 'chat_export')
select doc_id, cleaned, cast(length(text) - length(cleaned) as int) as removed from c""")
def cleaned_exports(spark: SparkSession, d: str) -> DataFrame:
    """Chat exports without placeholders, with what was taken away."""
    t = table(spark, d, "documents").where("kind = 'chat_export'")
    c = markup.cleaned_export(F.col("text"))
    return t.select("doc_id", c.alias("cleaned"), (F.length("text") - F.length(c)).alias("removed"))


@query("visible_lengths", """
select doc_id, length(replace(replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) as visible from documents where text is not null""")
def visible_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Characters that a reader sees."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(markup.visible_text(F.col("text"))).alias("visible"))


@query("masked_documents", """
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '护照', '[已脱敏]', 'g'), '签证', '[已脱敏]', 'g'), '美签', '[已脱敏]', 'g'), '留學打工', '[已脱敏]', 'g'), '留学打工', '[已脱敏]', 'g')) as masked from documents where text is not null""")
def masked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of texts with sensitive phrases masked."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(markup.masked_phrases(F.col("text"))).alias("masked"))


@query("posts_without_promo", """
with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: not (regexp_matches(x, '^#\\S') or regexp_matches(x, '^https?://'))) as keep from documents where text is not null)
select doc_id, md5(trim(regexp_replace(array_to_string(keep, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'))) as kept from l""")
def posts_without_promo(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of texts without tag lines and lines of one link."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(markup.without_lines(F.col("text"), [r"^#\S", "^https?://"])).alias("kept"))


@query("scored_contexts", """
with k as (select seq, local_path, list_filter([%s], lambda w: contains(lower(context), lower(w))) as hits, list_filter([%s], lambda w: contains(lower(context), lower(w))) as low from media_candidates),
s as (select seq, 0.2 + least(len(hits), 5) * 0.14 + case when local_path is not null then 0.08 else 0 end - case when len(low) > 0 and len(hits) = 0 then 0.2 else 0 end as x, len(hits) as n from k)
select seq, round(cast(greatest(0.0, least(x, 1.0)) as double), 6) as context_score, cast(n as int) as hits from s""" % tuple(", ".join(map(_q, x)) for x in (("活动", "价格", "额度", "bug", "风控", "封号", "报错", "教程", "入口", "二维码", "付款", "返现", "优惠", "羊毛", "截图", "表格", "评测", "模型", "账号", "冻结", "补件", "验证", "链接", "官方", "实测"), ("哈哈", "笑死", "表情", "梗图", "好图", "收藏", "自拍"))))  # fmt: skip
def scored_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Media by the words around them."""
    # Words of value and of none.
    value = ("活动", "价格", "额度", "bug", "风控", "封号", "报错", "教程", "入口", "二维码", "付款", "返现", "优惠", "羊毛", "截图", "表格", "评测", "模型", "账号", "冻结", "补件", "验证", "链接", "官方", "实测")
    low = ("哈哈", "笑死", "表情", "梗图", "好图", "收藏", "自拍")
    count = lambda ws: F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(F.lower("context"), F.lower(w))))
    t = table(spark, d, "media_candidates").select("seq", "local_path", count(value).alias("hits"), count(low).alias("low"))
    score = 0.2 + F.least("hits", F.lit(5)) * 0.14 + F.when(F.col("local_path").isNotNull(), 0.08).otherwise(0.0) - F.when((F.col("low") > 0) & (F.col("hits") == 0), 0.2).otherwise(0.0)
    return t.select("seq", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6).alias("context_score"), "hits")


@query("best_per_path", """
with r as (select *, row_number() over (partition by local_path order by score desc nulls last, seq) as n from media_candidates where local_path is not null)
select seq, local_path, platform, score from r where n = 1 order by (platform = 'Telegram') desc, score desc nulls last, seq limit 5""")
def best_per_path(spark: SparkSession, d: str) -> DataFrame:
    """The five media to cite: best of each path, one platform first, then by score."""
    from pyspark.sql import Window

    t = table(spark, d, "media_candidates").where("local_path is not null")
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("local_path").orderBy(F.desc_nulls_last("score"), "seq"))).where("n = 1")
    return t.orderBy(F.desc(F.col("platform") == "Telegram"), F.desc_nulls_last("score"), "seq").limit(5).select("seq", "local_path", "platform", "score")


@query("routes_with_default", "select seq, coalesce(r.target, 'default') as target from media_candidates m left join (values ('微信', 'topic-1'), ('Telegram', 'topic-2')) r(platform, target) on r.platform = m.platform")
def routes_with_default(spark: SparkSession, d: str) -> DataFrame:
    """Where each candidate goes; the default where nothing is said."""
    routes = spark.createDataFrame([("微信", "topic-1"), ("Telegram", "topic-2")], "platform string, target string")
    return table(spark, d, "media_candidates").join(routes, "platform", "left").select("seq", F.coalesce("target", F.lit("default")).alias("target"))
