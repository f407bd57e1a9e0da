"""Queries of identities, readings and state: spellings, coerced values, marks, leases, parts of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions import cards, coerce, jsontext, markup
from quaylight.operators import records, scan, state
from quaylight.plans.registry import query
from quaylight.sources import device
from quaylight.sources.tables import table


@query("chat_id_spellings", """
with c as (select distinct try_cast(chat_id as bigint) as n from content_seen), d as (select n, cast(abs(n) as varchar) as s from c where n is not null)
select n as chat_id, list_sort(list_distinct(case when s like '100_%' then [n, abs(n), cast(substr(s, 4) as bigint)] else [n, abs(n), cast('100' || s as bigint), -cast('100' || s as bigint)] end)) as spellings from d""")
def chat_id_spellings(spark: SparkSession, d: str) -> DataFrame:
    """All numbers under which each chat may be stored."""
    c = table(spark, d, "content_seen").select(F.col("chat_id").try_cast("bigint").alias("chat_id")).distinct().where("chat_id is not null")
    return c.select("chat_id", scan.chat_ids_col(F.col("chat_id")).alias("spellings"))


@query("linked_html", r"""
select doc_id, md5(regexp_replace(text, '\[([^\]]+)\]\((https?://[^)]+)\)', '<a href="\2">\1</a>', 'g')) as html from documents where text is not null and not regexp_matches(text, '\[[^\]]*[&"][^\]]*\]\(http|\]\(https?://[^)]*&')""")
def linked_html(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of texts with markdown links as anchors, those without anything to escape in a link."""
    t = table(spark, d, "documents").where("text is not null").where(~F.col("text").rlike(r'\[[^\]]*[&"][^\]]*\]\(http|\]\(https?://[^)]*&'))
    return t.select("doc_id", F.md5(markup.links_as_html(F.col("text"))).alias("html"))


@query("escaped_titles", r"""
select seq, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html, regexp_replace(title, '([_*\[\]()~`>#+\-=|{}.!\\])', '\\\1', 'g') as markdown, translate(title, '/:\' || chr(0), '____') as file_name from bili_videos""")
def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles escaped for two dialects and as names of files."""
    t = F.col("title")
    return table(spark, d, "bili_videos").select("seq", markup.escaped_html(t).alias("html"), markup.escaped_markdown(t).alias("markdown"), markup.safe_file_name(t).alias("file_name"))


@query("message_part_sizes", r"""
with recursive p as (
 select doc_id, 0 as part_no, coalesce(text, '') as whole, length(coalesce(text, '')) <= 3900 as ended, case when length(coalesce(text, '')) <= 3900 then coalesce(text, '') end as part, coalesce(text, '') as rest, true as first from documents
 union all
 select doc_id, case when first then 0 else part_no + 1 end, whole, length(rest) <= 3900,
  case when length(rest) <= 3900 then rest else regexp_replace(left(rest, cut), '\n+$', '') end, case when length(rest) <= 3900 then '' else regexp_replace(substr(rest, cut + 1), '^\n+', '') end, false
 from (select *, case when left(rest, 3900) like '%' || chr(10) || '%' and length(regexp_extract(left(rest, 3900), '(?s)^(.*)\n', 1)) >= 1950 then length(regexp_extract(left(rest, 3900), '(?s)^(.*)\n', 1)) else 3900 end as cut from p where not ended and rest <> '')
) select doc_id, cast(part_no as int) as part_no, cast(length(part) as int) as chars from p where part is not null""")
def message_part_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Parts of documents that fit a message of 3,900 characters."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(markup.message_parts_col(F.col("text"), 3900)).alias("part_no", "part"))
    return t.select("doc_id", "part_no", F.length("part").alias("chars"))


@query("captions_of_digests", r"""
with v as (select doc_id, text, replace(replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') as seen from documents where text is not null)
select doc_id, md5(case when length(seen) <= 1024 then text else left(seen, 1024) end) as caption, case when length(seen) <= 1024 then 'HTML' end as mode from v""")
def captions_of_digests(spark: SparkSession, d: str) -> DataFrame:
    """Captions: whole where what is seen fits, else cut and plain."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", markup.caption(F.col("text")).alias("c"))
    return t.select("doc_id", F.md5("c.text").alias("caption"), "c.mode")


@query("durations_rendered", r"""
with s as (select seq, try_cast(nullif(regexp_extract(duration, '^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$', 1), '') as bigint) as h, try_cast(nullif(regexp_extract(duration, '^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$', 2), '') as bigint) as m, try_cast(nullif(regexp_extract(duration, '^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$', 3), '') as bigint) as x, title from bili_videos),
t as (select seq, title, case when h is not null or m is not null or x is not null then coalesce(h, 0) * 3600 + coalesce(m, 0) * 60 + coalesce(x, 0) end as s from s)
select seq, case when s > 0 then case when s >= 3600 then (s // 3600) || 'h' else '' end || case when s >= 60 then (s % 3600 // 60) || 'm' else '' end || (s % 60) || 's' end as duration, coalesce(s <= 60, contains(lower(title), '#shorts'), false) as short from t""")
def durations_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Durations read and written again, and which videos are shorts: known to last a minute at most, or unknown and titled so."""
    s = coerce.clock_duration_seconds(F.col("duration"))
    short = F.coalesce(s <= 60, F.contains(F.lower("title"), F.lit("#shorts")), F.lit(False))
    return table(spark, d, "bili_videos").select("seq", coerce.duration_text(s).alias("duration"), short.alias("short"))


@query("publish_epochs", r"""
with t as (select seq, trim(publish_time, chr(9) || chr(10) || chr(13) || ' ') as x from bili_videos where publish_time is not null), n as (select seq, case when regexp_full_match(x, '[+-]?\d+(\.0*)?') then try_cast(try_cast(x as decimal(38, 6)) as bigint) end as number from t)
select seq, number, case when number > 0 and number <= 4102444800 then make_timestamp(number * 1000000) end as at from n""")
def publish_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Publishing times that are whole numbers, and those of them that are seconds since 1970."""
    n = coerce.whole_number(F.col("publish_time"))
    return table(spark, d, "bili_videos").where("publish_time is not null").select("seq", n.alias("number"), coerce.epoch_seconds(n).cast("timestamp_ntz").alias("at"))


@query("scores_scaled", """
select seq, case when score is null or isnan(score) or score < 0 or score > 100 then 0.0 when score <= 1 then score when score <= 10 then score / 10 else score / 100 end as score,
 coalesce(lower(trim(media_type)) in ('true', 'yes', 'y', '1', '是', '同一事件', 'same'), false) as flag, case when platform in ('微信', 'Telegram') then platform else 'other' end as platform from media_candidates""")
def scores_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Scores brought to 0..1, a flag and a value of a closed set."""
    return table(spark, d, "media_candidates").select("seq", coerce.score_to_one(F.col("score")).alias("score"), coerce.flag(F.col("media_type")).alias("flag"), coerce.one_of(F.col("platform"), ["微信", "Telegram"], "other").alias("platform"))


@query("year_progress_of_days", """
select distinct report_day, round((dayofyear(report_day)) / (date_diff('day', date_trunc('year', report_day), date_trunc('year', report_day) + interval 1 year)), 9) as share from activity_days""")
def year_progress_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Share of the year that is over on each day."""
    return table(spark, d, "activity_days").select("report_day").distinct().select("report_day", F.round(coerce.year_progress(F.col("report_day")), 9).alias("share"))


@query("media_by_words", """
with t as (select doc_id, lower(text) as t from documents where text is not null)
select doc_id, case when contains(t, 'photo') or contains(t, 'image') then '图片' when contains(t, 'webpage') then '链接卡片' when contains(t, 'document') then '文件' else '媒体' end as media_type
from t where contains(t, 'photo') or contains(t, 'image') or contains(t, 'document') or contains(t, 'media') or contains(t, 'webpage')""")
def media_by_words(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name media, and the type they name."""
    t = table(spark, d, "documents").where("text is not null").where(jsontext.has_media(F.col("text")))
    return t.select("doc_id", jsontext.media_type(F.col("text")).alias("media_type"))


@query("image_paths_of_candidates", r"""
select seq, list_filter([local_path, raw_ref, context], lambda v: v is not null and regexp_full_match(lower(v), '.*\.(png|jpg|jpeg|webp)') and (contains(v, '/') or starts_with(v, '~'))) as paths from media_candidates where local_path is not null""")
def image_paths_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Paths of images among the leaves of candidates written as JSON."""
    m = table(spark, d, "media_candidates").where("local_path is not null")
    raw = F.to_json(F.struct(F.col("local_path").alias("file"), F.struct("raw_ref", "context").alias("of")))
    return m.select("seq", jsontext.image_paths(raw).alias("paths"))


@query("workouts_of_events", """
select event_id, event_type as name, make_timestamp((978307200 + event_id) * 1000000) as started, round(value / 60, 9) as duration_min, round(case when value > 0 then value / 4.184 end, 9) as active_kcal, case when user_id % 3 = 0 then null else cast(user_id % 3 as double) end as distance_km from events""")
def workouts_of_events(spark: SparkSession, d: str) -> DataFrame:
    """Events taken as workouts of a device: its epoch, seconds and kilojoules."""
    e = table(spark, d, "events")
    w = e.select(F.col("event_type").alias("name"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), F.col("value").alias("duration"), F.col("value").cast("string").alias("activeEnergy"), (F.col("user_id") % 3).alias("totalDistance"))
    s = device.workout_summaries(w)
    return s.select((F.unix_timestamp("started") - coerce.DEVICE_EPOCH).alias("event_id"), "name", F.col("started").cast("timestamp_ntz").alias("started"), F.round("duration_min", 9).alias("duration_min"), F.round("active_kcal", 9).alias("active_kcal"), "distance_km")


@query("leads_after_signals", """
with l as (select distinct id, title, status, death_signal, category, captured_at from hot_leads),
t as (select title, min(id) as one from l group by 1 having count(distinct id) = 1),
s as (select captured_at || id as o, title as target, case when length(title) % 3 = 0 then 'HIGH' when length(title) % 3 = 1 then 'medium' else 'low' end as confidence, category as signal from l),
m as (select t.one as id, arg_max(case when lower(confidence) = 'high' then 'dead' else 'likely_dead' end, o) as status, arg_max(coalesce(signal, ''), o) as signal from s join t on t.title = trim(s.target) where lower(confidence) <> 'low' and trim(target) <> '' group by 1)
select l.id, coalesce(m.status, l.status) as status, coalesce(m.signal, l.death_signal) as death_signal from l left join m on m.id = l.id""")
def leads_after_signals(spark: SparkSession, d: str) -> DataFrame:
    """Leads whose status signals have changed: sure ones end a lead, likely ones mark it, unsure ones and shared titles do nothing."""
    leads = table(spark, d, "hot_leads").select("id", "title", "status", "death_signal", "category", "captured_at").distinct()
    confidence = F.when(F.length("title") % 3 == 0, "HIGH").when(F.length("title") % 3 == 1, "medium").otherwise("low")
    signals = leads.select(F.concat("captured_at", "id").alias("order"), F.col("title").alias("target"), confidence.alias("confidence"), F.col("category").alias("signal"))
    marks = records.signal_marks(signals, leads.select("id", "title"))
    return state.marked(leads, marks, "id").select("id", "status", "death_signal")


@query("leases_of_segments", """
with g as (select distinct id, status, score, sent_at, sent_style from growth_segments), p as (select id, score, row_number() over (order by score desc, id) as n from g where status = 'pending')
select g.id, case when n = 1 then 'sent' when n = 2 then 'pending' when n = 3 then 'sending' else status end as status, case when n = 3 then 'run-3' end as owner, case when n = 3 then timestamp '2026-06-08 00:30:00' end as lease_until,
 case when n = 1 then '2026-06-08T00:05:00' else sent_at end as sent_at, case when n = 1 then 'A' else sent_style end as sent_style from g left join p using (id)""")
def leases_of_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments after three runs have leased one each: the first sends its own, the second gives its own back, the third prolongs it; strangers change nothing."""
    g = table(spark, d, "growth_segments").select("id", "status", "score", "sent_at", "sent_style").distinct()
    g = g.withColumns({"owner": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp")})
    best = g.where("status = 'pending'").orderBy(F.desc("score"), "id").limit(3).select("id")  # the three that are leased: the feature
    ids = [r[0] for r in best.collect()]
    now = "2026-06-08 00:00:00"
    for i, k in enumerate(ids):
        mine = F.col("id") == k
        g = g.withColumn("status", F.when(mine, "sending").otherwise(F.col("status"))).withColumn("owner", F.when(mine, f"run-{i + 1}").otherwise(F.col("owner"))).withColumn("lease_until", F.when(mine, F.lit("2026-06-08 00:15:00").cast("timestamp")).otherwise(F.col("lease_until")))
    for i, k in enumerate(ids):
        g = state.sent(g, "id", k, "A", "2026-06-08T00:05:00", "run-1")
        g = state.released(g, "id", k, "run-2")
        g = state.renewed(g, "id", k, "run-3", now, 1800)
    return g.select("id", "status", "owner", F.col("lease_until").cast("timestamp_ntz").alias("lease_until"), "sent_at", "sent_style")


@query("summaries_parsed", """
select doc_id, md5(trim(text, chr(10) || chr(9) || chr(32))) as concise, '{"hot_leads_additions":[],"n":' || doc_id || '}' as opportunities, case when doc_id % 2 = 0 then '{"checked_claims":[]}' end as verification, case when doc_id % 2 = 0 then '' else 'verification' end as faults
from documents where text is not null and not contains(text, '```') and not contains(text, chr(13)) and length(trim(text, chr(10) || chr(9) || chr(32))) > 0 and regexp_full_match(text, '(?s)[!-~].*[!-~。！？]')""")
def summaries_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers in fenced blocks taken apart: made of each text, with a broken JSON block, and with or without an untagged verification."""
    t = table(spark, d, "documents").where("text is not null and not contains(text, '```') and not contains(text, char(13))")
    t = t.where(F.col("text").rlike(r"^(?s)[!-~].*[!-~。！？]$"))
    fence = lambda kind, body: F.concat(F.lit(f"```{kind}\n"), body, F.lit("\n```\n"))
    broken = F.concat(F.lit('{"hot_leads_additions": [], "n": '), F.col("doc_id"), F.lit(","))
    answer = F.concat(F.lit("before\n"), fence("markdown concise", F.col("text")), fence("json opportunities", broken), F.when(F.col("doc_id") % 2 == 0, fence("json", F.lit('{"checked_claims": [],}'))).otherwise(""))
    s = t.select("doc_id", jsontext.summary_parts_col(answer).alias("s"))
    return s.select("doc_id", F.md5("s.concise").alias("concise"), "s.opportunities", "s.verification", "s.faults")


@query("source_labels", r"""
with n as (select distinct platform || ' /  ' || group_name || '/x ' as name from media_candidates union select distinct group_name from media_candidates)
select name, case when regexp_matches(name, '^\s*(微信|Telegram) */') then regexp_replace(trim(regexp_replace(name, '^ *(微信|Telegram) */', '')), ' */ *', ' / ', 'g') else trim(name) end as label from n where name is not null""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of sources as they are shown, with and without their platform."""
    m = table(spark, d, "media_candidates")
    names = m.select(F.concat("platform", F.lit(" /  "), "group_name", F.lit("/x ")).alias("name")).union(m.select("group_name")).where("name is not null").distinct()
    return names.select("name", cards.source_label(F.col("name")).alias("label"))


@query("points_rendered", r"""
with s as (select distinct id, points, date, start_hm, end_hm from growth_segments)
select id, list_transform(points, lambda x: replace(regexp_replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\*\*(.+?)\*\*', '<b>\1</b>', 'gs'), '**', '')) as points, '<i>📍 ' || date || ' · ' || start_hm || '–' || end_hm || '</i>' as footer from s""")
def points_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Points of segments in the markup of messages, and the line below them."""
    s = table(spark, d, "growth_segments").select("id", "points", "date", "start_hm", "end_hm").distinct()
    return s.select("id", F.transform("points", cards.rendered_point).alias("points"), cards.segment_footer(F.col("date"), F.col("start_hm"), F.col("end_hm")).alias("footer"))


@query("rubric_versions", r"""
with v as (select case when regexp_matches(regexp_extract(coalesce(text, ''), '^([^\n\r]*)', 1), '\bv\d+\b') then regexp_extract(regexp_extract(coalesce(text, ''), '^([^\n\r]*)', 1), '\b(v\d+)\b', 1) else 'v0' end as version from documents) select version, count(*) as n from v group by 1""")
def rubric_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the version that their first line names."""
    return table(spark, d, "documents").groupBy(cards.rubric_version(F.col("text")).alias("version")).agg(F.count("*").alias("n"))


@query("deltas_of_days", """
with a as (select distinct device_id, report_day, steps, resting_hr, exercise_min from activity_days), b as (select device_id, avg(steps) as s from a group by 1),
x as (select a.*, round_even(steps - s, 0) as d, cast(round_even(exercise_min, 0) as bigint) as m from a join b using (device_id))
select device_id, report_day, case when d is null then '—' when d = 0 then '0步' else printf('%+d', cast(d as bigint)) || '步' end as steps_delta, case when m is null then '—' else (m // 60) || '小时' || lpad(cast(m % 60 as varchar), 2, '0') || '分' end as exercise from x""")
def deltas_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a day against the device's mean, and time of exercise, as they are written in a report."""
    a = table(spark, d, "activity_days").select("device_id", "report_day", "steps", "resting_hr", "exercise_min").distinct()
    b = a.groupBy("device_id").agg(F.avg("steps").alias("s"))
    return a.join(b, "device_id").select("device_id", "report_day", cards.signed_delta(F.col("steps"), F.col("s"), "步").alias("steps_delta"), cards.hours_text(F.col("exercise_min") / 60).alias("exercise"))


@query("images_left_out", """
select seq from media_candidates where coalesce((media_type in ('meme', 'unknown') and score < 0.75), false) or coalesce(score < 0.55 and local_path is null, false) or regexp_matches(coalesce(context, ''), '表情包|无文字|纯图片')""")
def images_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that say too little to be shown; a path stands for facts."""
    facts = F.when(F.col("local_path").isNull(), F.array().cast("array<string>")).otherwise(F.array("local_path"))
    return table(spark, d, "media_candidates").where(cards.is_empty_image(F.col("media_type"), F.col("score"), facts, F.col("context"))).select("seq")
