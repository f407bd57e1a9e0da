"""Queries of decisions and assembly over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions import jsontext, markup
from quaylight.operators import records
from quaylight.plans.registry import query
from quaylight.sources.tables import table


@query("gate_decisions")
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document would be held back, given all that were delivered before it."""
    docs = table(spark, d, "documents").select("doc_id", "text", "published_at")
    return records.gate_decisions_in_order(docs, "doc_id", "text", ["published_at", "doc_id"])


@query("resolved_targets", """
with leads as (select distinct id, title from hot_leads), segs as (select distinct id, theme as title from growth_segments),
t as (select distinct title as target from leads union select distinct id from segs union select distinct title from segs union select 'nobody'),
l as (select title, count(*) as n, min(id) as id from leads group by 1), g as (select title, count(*) as n, min(id) as id from segs group by 1)
select target, case when a.id is not null or l.n = 1 then 0 when b.id is not null or g.n = 1 then 1 end as table_no, coalesce(a.id, case when l.n = 1 then l.id end, b.id, case when g.n = 1 then g.id end) as id
from t left join (select distinct id from leads) a on a.id = target left join (select distinct id from segs) b on b.id = target left join l on l.title = target left join g on g.title = target where target is not null""")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """What names in signals point to: an id, or the title of just one row; leads before segments."""
    leads = table(spark, d, "hot_leads").select("id", "title").distinct()
    segs = table(spark, d, "growth_segments").select("id", F.col("theme").alias("title")).distinct()
    names = leads.select(F.col("title").alias("target")).unionByName(segs.select(F.col("id").alias("target"))).unionByName(segs.select(F.col("title").alias("target"))).unionByName(spark.createDataFrame([("nobody",)], "target string"))
    return records.resolved_targets(names.where("target is not null").distinct(), "target", leads, segs)


@query("valid_quotes", """
with s as (select distinct id, quotes from growth_segments), q as (select id as span, unnest(quotes) as q, generate_subscripts(quotes, 1) - 1 as pos from s),
n as (select span, pos, q.msg_id as named, q.text as t, regexp_replace(q.text, '\\s+', '', 'g') as needle from q), k as (select * from n where length(needle) between 6 and 160),
m as (select span, pos, q.msg_id as msg_id, q.sender as sender, q.text as content, regexp_replace(q.text, '\\s+', '', 'g') as hay from q),
h as (select k.span, k.pos, k.needle, m.msg_id, m.sender, m.content, row_number() over (partition by k.span, k.pos order by (m.msg_id <> k.named), m.msg_id) as rn from k join m on m.span = k.span and contains(m.hay, k.needle)),
o as (select *, row_number() over (partition by span order by pos) as n from h where rn = 1) select span, cast(pos as int) as pos, msg_id, coalesce(sender, '') as sender,
 regexp_extract(content, array_to_string(list_transform(string_split(needle, ''), lambda c: regexp_escape(c)), '\\s*')) as quote from o where n <= 3""")
def valid_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of a segment found again among its messages."""
    s = table(spark, d, "growth_segments").select("id", "quotes").distinct().select(F.col("id").alias("span"), F.posexplode("quotes").alias("pos", "q"))
    q = s.select("span", "pos", "q.msg_id", "q.text")
    m = s.select("span", "q.msg_id", "q.sender", F.col("q.text").alias("content"))
    return records.valid_quotes(q, m)


@query("grouped_posts", """
with e as (select event_id as seq, case when event_type = 'view' then user_id end as g, case when value > 20 then event_type || ' ' || event_id end as t from events),
k as (select *, case when g is null then 'm' || seq else 'g' || g end as k from e)
select min(seq) as seq, coalesce(arg_min(t, seq) filter (t is not null), '') as text, count(*) as parts from k group by k""")
def grouped_posts(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one album as one post."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_id").alias("msg_id"), F.when(F.col("event_type") == "view", F.col("user_id")).alias("grouped_id"), F.when(F.col("value") > 20, F.concat_ws(" ", "event_type", "event_id")).alias("text"), F.lit(None).cast("array<struct<path:string,kind:string>>").alias("media"))
    return records.grouped_posts(e).select("seq", "text", F.size("msg_ids").cast("bigint").alias("parts"))


@query("digest_sections", r"""
with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) as raw, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) - 1 as line_no from documents where kind = 'digest' and text is not null),
t as (select doc_id, line_no, trim(raw) as line from l where trim(raw) <> ''),
h as (select *, case when line like '#%' then case when regexp_matches(line, '(?i)模型|model|token') then 'models' when regexp_matches(line, '账|额度|account|budget') then 'accounts' when line like '## %' then 'other' else '' end end as head from t),
s as (select *, last_value(head ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from h),
i as (select doc_id, section, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^- +', ''), '\*\*', '', 'g'), '[ \t]*\[IMG\d+\]', '', 'g'), '\[([^\]\n]+)\]\((https?://[^)\s]+)\)', '\1', 'g')) as item from s where line not like '#%' and section <> '')
select doc_id, section, list(item order by line_no) as items from i where item <> '' group by 1, 2""")
def digest_sections(spark: SparkSession, d: str) -> DataFrame:
    """Items of digests under second-level headings, by a word of the heading."""
    t = table(spark, d, "documents").where("kind = 'digest' and text is not null")
    return records.sections(t, "doc_id", "text", {"(?i)模型|model|token": "models", "账|额度|account|budget": "accounts", "^## ": "other"})


@query("claims_of_digests", r"""
with l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) as raw, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) - 1 as line_no from documents where kind = 'digest' and text is not null),
t as (select doc_id, line_no, trim(raw) as line from l where regexp_matches(trim(raw), '^-\s+.+$')),
q as (select doc_id, line_no, trim(regexp_extract(line, '^-\s+\*\*([^*]+)\*\*[：:]', 1)) || ' ' || trim(regexp_replace(line, '^-\s+(?:\*\*[^*]+\*\*[：:])?', '')) as c from t),
k as (select doc_id, line_no, trim(regexp_replace(trim(c), '（[^）]+ / \d{2}:\d{2}[^）]*）$', '')) as claim from q),
w as (select doc_id, claim, min(line_no) as line_no from k where list_aggregate(list_transform(['发布', '推出', '涨价', '降价', '封禁', '封锁', '退出', '裁员', '额度', '风控', '警告', '验证', '第一', 'LiveBench', '版本', 'Pro', 'Plus', 'Claude', 'Grok', 'GPT', 'Codex', 'Gemini', '美元', '元', '免税', 'VPN', '政策', '红头文件'], lambda w: contains(claim, w)), 'bool_or') or regexp_matches(claim, '\d+(?:\.\d+)+') group by 1, 2),
n as (select *, row_number() over (partition by doc_id order by line_no) as pos from w) select doc_id, cast(pos as int) as pos, claim from n where pos <= 12""")
def claims_of_digests(spark: SparkSession, d: str) -> DataFrame:
    """Bullets of digests that claim something."""
    return records.claims(table(spark, d, "documents").where("kind = 'digest' and text is not null"), "doc_id", "text")


@query("digests_as_html")
def digests_as_html(spark: SparkSession, d: str) -> DataFrame:
    """Digests in the markup of messages, cut into parts that fit."""
    t = table(spark, d, "documents").where("kind = 'digest' and text is not null")
    return t.select("doc_id", F.posexplode(markup.message_parts_col(records.message_html(F.col("text")), 3900)).alias("part_no", "part"))


@query("prompts_by_producer", """
with c as (select distinct msg_id, producer, text from delivered) select producer, md5('cards:' || chr(10) || string_agg('[' || msg_id || '] ' || text, chr(10) order by msg_id)) as prompt from c group by 1""")
def prompts_by_producer(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the transcripts of a producer's cards."""
    c = table(spark, d, "delivered").select("msg_id", "producer", "text").distinct()
    p = records.prompts(c, "producer", "msg_id", F.concat(F.lit("["), F.col("msg_id"), F.lit("] "), F.col("text")), "cards:\n")
    return p.select("producer", F.md5("prompt").alias("prompt"))


@query("points_cleaned", """
with s as (select distinct id, points from growth_segments) select id, list_slice(list_transform(list_filter(list_transform(points, lambda x: trim(x)), lambda x: x is not null and replace(x, '**', '') <> ''), lambda x: case when length(replace(x, '**', '')) <= 30 then x else substr(replace(x, '**', ''), 1, 30) end), 1, 5) as points from s""")
def points_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Points of segments, at most five of 30 characters."""
    return table(spark, d, "growth_segments").select("id", "points").distinct().select("id", records.clean_points(F.col("points"), longest=30).alias("points"))


@query("thresholds_suggested", """
with e as (select cast(floor(value / 50) as int) as band, event_type in ('view', 'click') as same from events), g as (select band, avg(case when same then 1.0 else 0.0 end) as rate from e group by 1)
select min(case when rate >= 0.5 then band / 10 end) as candidate, min(case when rate >= 0.9 then band / 10 end) as strong from g""")
def thresholds_suggested(spark: SparkSession, d: str) -> DataFrame:
    """Lowest bands at which half and most of the pairs are judged the same."""
    e = table(spark, d, "events").select(F.floor(F.col("value") / 50).cast("int").alias("band"), F.col("event_type").isin("view", "click").alias("same"))
    return records.suggested_thresholds(e.withColumn("low", F.col("band") / 10), "band", "low", F.col("same"))


@query("titles_merged")
def titles_merged(spark: SparkSession, d: str) -> DataFrame:
    """Leads of a category under the first one with a similar title."""
    t = table(spark, d, "hot_leads").select("id", "category", "title").distinct()
    m = records.merged_by_title(t, "category", "id", "title")
    return m.groupBy("category", "head").agg(F.count("*").alias("n"))


@query("json_leaf_types", """select 'k' as leaf, count(*) as n, min(cast(json_extract(props, '$.k') as bigint)) as least from events where json_valid(props)""")
def json_leaf_types(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the JSON of all events."""
    jsontext.register_json_functions(spark)
    table(spark, d, "events").select("event_id", "props").createOrReplaceTempView("json_events")
    return spark.sql("select substr(l.path, 3) as leaf, count(*) as n, min(cast(l.value as bigint)) as least from json_events e, lateral json_leaves(e.props) l group by 1")


@query("oldest_active", """
with l as (select distinct id, captured_at, status, category from hot_leads) select id from l where status = 'alive' and cast(captured_at as date) >= date '2024-06-01' order by captured_at, id limit 50""")
def oldest_active(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 live leads of a period, oldest first: the limit is the feature."""
    t = table(spark, d, "hot_leads").select("id", "captured_at", "status").distinct()
    return t.where((F.col("status") == "alive") & (F.to_date("captured_at") >= F.lit("2024-06-01").cast("date"))).orderBy("captured_at", "id").limit(50).select("id")
