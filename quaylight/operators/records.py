"""Decisions and assembly over records: gates, name resolution, quotes, posts, digests, citations, plug-in models."""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions import identity, markup
from quaylight.operators.dedup import first_owner
from quaylight.session import materialize


def gate_decisions(new: DataFrame, seen: DataFrame, key: str, text: str) -> DataFrame:
    """key, skip, reason, owner: a text seen before is skipped; a link seen before only if the post is hardly more than it.

    ``seen`` (key, owner, order) holds text: and url: keys; of several hits the earliest owner counts. A post
    without any hit, with commentary, or without a key is delivered.
    """
    own = first_owner(seen.select("key", "owner", "order"), "key", ["order"]).select("key", "owner", "order")
    n = new.select(F.col(key).alias("k"), F.explode(identity.seen_keys_col(F.col(text))).alias("key"), identity.is_bare_link(F.col(text)).alias("bare"))
    hit = n.join(own, "key").where(F.col("key").startswith("text:") | F.col("bare"))
    reason = F.when(F.col("key").startswith("text:"), "text").otherwise("url")
    best = hit.groupBy("k").agg(F.min(F.struct(reason.alias("reason"), F.col("order"), F.col("owner"))).alias("h"))
    j = new.select(F.col(key).alias("k")).distinct().join(best, "k", "left")
    return j.select(F.col("k").alias(key), F.col("h").isNotNull().alias("skip"), F.coalesce("h.reason", F.lit("")).alias("reason"), F.col("h.owner").alias("owner"))


def gate_decisions_in_order(df: DataFrame, key: str, text: str, order: list[str], most_rounds: int = 60) -> DataFrame:
    """As ``gate_decisions``, for every post of one table against those before it in ``order`` (ties excluded) that were delivered.

    A post that is skipped doesn't register its keys.  Owners are first those of all posts, then of the
    posts that the last round delivered, until no decision changes; what holds then is the outcome of one post after another.
    """
    rows = df.select(F.col(key).alias("k"), F.struct(*order).alias("at"), identity.is_bare_link(F.col(text)).alias("bare"), F.explode(identity.seen_keys_col(F.col(text))).alias("key"))
    rows = materialize(rows.groupBy("k", "key").agg(F.min("at").alias("at"), F.bool_or("bare").alias("bare")), "keys")
    reason = F.when(F.col("key").startswith("text:"), "text").otherwise("url")
    best, before = None, None
    for _ in range(most_rounds):
        delivered = rows if best is None else rows.join(best, "k", "left_anti")
        own = first_owner(delivered.select("key", F.col("k").alias("owner"), F.col("at").alias("order")), "key", ["order"]).select("key", "owner", "order")
        hit = rows.join(own, "key").where((F.col("key").startswith("text:") | F.col("bare")) & (F.col("order") < F.col("at")) & (F.col("owner") != F.col("k")))
        best = materialize(hit.groupBy("k").agg(F.min(F.struct(reason.alias("reason"), F.col("order"), F.col("owner"))).alias("h")), "hits")
        now = tuple(best.agg(F.count("*"), F.sum(F.xxhash64("k", "h").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("gate decisions did not settle")
    j = df.select(F.col(key).alias("k")).distinct().join(best, "k", "left")
    return j.select(F.col("k").alias(key), F.col("h").isNotNull().alias("skip"), F.coalesce("h.reason", F.lit("")).alias("reason"), F.col("h.owner").alias("owner"))


def resolved_targets(signals: DataFrame, target: str, *tables: DataFrame) -> DataFrame:
    """Each signal with ``table_no`` and ``id``: of the first table that has the target as an id, or as the title of just one row.

    A title that several rows share resolves to nothing in its table.
    """
    ids, titles = [], []
    for i, t in enumerate(tables):
        ids.append(t.select(F.col("id").alias("name"), F.lit(2 * i).alias("rank"), "id").distinct())
        one = t.groupBy(F.col("title").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
        titles.append(one.select("name", F.lit(2 * i + 1).alias("rank"), "id"))
    names = ids[0]
    for x in [*ids[1:], *titles]:
        names = names.unionByName(x)
    best = names.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.min(F.struct("rank", "id")).alias("r"))
    j = signals.join(best, F.trim(signals[target]) == best["name"], "left")
    return j.select(*signals.columns, F.floor(F.col("r.rank") / 2).cast("int").alias("table_no"), F.col("r.id").alias("id"))


# What a signal's confidence does.
SIGNAL_STATUS = {"high": "dead", "medium": "likely_dead"}


def signal_marks(signals: DataFrame, *tables: DataFrame) -> DataFrame:
    """table_no, id, order, status, death_signal of signals (order, target, confidence, signal): what is to be marked by them.

    A signal of another confidence, without target, or whose target is found nowhere marks nothing; one without text leaves an empty one.
    """
    confidence = F.lower(F.col("confidence"))
    status = F.coalesce(*[F.when(confidence == k, v) for k, v in SIGNAL_STATUS.items()])
    s = signals.withColumn("status", status).where("status is not null and trim(target) <> ''")
    found = resolved_targets(s, "target", *tables).where("id is not null")
    return found.select("table_no", "id", "order", "status", F.coalesce("signal", F.lit("")).alias("death_signal"))


def valid_quotes(quotes: DataFrame, messages: DataFrame, most: int = 3, shortest: int = 6, longest: int = 160) -> DataFrame:
    """Quotes that stand in a message of their span but for white space: span, msg_id, sender, quote (as the message has it).

    ``quotes`` (span, pos, msg_id, text), ``messages`` (span, msg_id, sender, content). The message that the quote
    names comes first, else the first that contains it; at most ``most`` a span, in the order of ``pos``.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    q = quotes.select("span", "pos", F.col("msg_id").alias("named"), F.col("text").alias("q"), bare(F.col("text")).alias("needle")).where(F.length("needle").between(shortest, longest))
    m = messages.select("span", "msg_id", "sender", "content", bare(F.col("content")).alias("hay"))
    hit = q.join(m, "span").where(F.contains("hay", "needle"))
    best = hit.groupBy("span", "pos").agg(F.min_by(F.struct("msg_id", "sender", "content", "q"), F.struct((F.col("msg_id") != F.col("named")).alias("other"), "msg_id")).alias("b"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("span").orderBy("pos"))).where(F.col("n") <= most)
    return best.select("span", "pos", "b.msg_id", F.coalesce("b.sender", F.lit("")).alias("sender"), markup.verbatim(F.col("b.content"), F.col("b.q")).alias("quote"))


def grouped_posts(manifest: DataFrame) -> DataFrame:
    """One row a post: rows of one grouped_id together, others alone; first non-empty text, all media and ids in order.

    ``manifest`` (seq, msg_id, grouped_id, text, media array<struct<path, kind>>).
    """
    k = F.coalesce(F.concat(F.lit("g"), F.col("grouped_id").cast("string")), F.concat(F.lit("m"), F.col("seq").cast("string")))
    has = F.trim(F.coalesce("text", F.lit(""))) != ""
    parts = F.array_sort(F.collect_list(F.struct("seq", "msg_id", "media")))
    g = manifest.groupBy(k.alias("k")).agg(F.min("seq").alias("seq"), F.min_by(F.when(has, F.trim("text")), F.when(has, F.col("seq"))).alias("text"), parts.alias("p"))
    return g.select("seq", F.coalesce("text", F.lit("")).alias("text"), F.transform("p", lambda x: x["msg_id"]).alias("msg_ids"), F.flatten(F.transform("p", lambda x: F.coalesce(x["media"], F.array().cast("array<struct<path:string,kind:string>>")))).alias("media"))


def sections(df: DataFrame, key: str, text: str, wanted: dict[str, str]) -> DataFrame:
    """Lines of a digest by the section that their heading names: key, section, items in order.

    ``wanted``: pattern of a heading to the name of its section; lines under other headings are left out.
    """
    from quaylight.sources.exports import lines

    rows = lines(df.select(key, text), text).where("line <> ''")
    head = F.col("line").startswith("#")
    name = F
    for p, s in wanted.items():
        name = name.when(F.col("line").rlike(p), s)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(head, F.coalesce(name.otherwise(F.lit("")), F.lit(""))), ignorenulls=True).over(w))
    item = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^- +", ""), r"\*\*", ""), r"[ \t]*\[IMG\d+\]", ""), identity.MD_LINK, "$1")
    rows = rows.where(~head & (F.col("section") != "")).withColumn("item", F.trim(item)).where("item <> ''")
    return rows.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "item"))), lambda x: x["item"]).alias("items"))


def kept_citations(df: DataFrame, key: str, text: str, known: DataFrame, preferred: str, least: str, most: int = 3) -> DataFrame:
    """key, image_id, at: the citations [IMGn] to show, each known image once and at most ``most``.

    Of an image's places one in a section of ``preferred`` comes first, one in a section of ``least`` last, then the earlier one;
    the same order picks the images.
    """
    from quaylight.sources.exports import lines

    rows = lines(df.select(key, text), text)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.coalesce(F.last(F.when(F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(w), F.lit("")))
    c = rows.select(key, "line_no", "heading", F.posexplode(F.regexp_extract_all("line", F.lit(r"\[IMG(\d+)\]"), F.lit(1))).alias("i", "image_id"))
    c = c.withColumn("image_id", F.col("image_id").cast("bigint")).join(known.select(key, "image_id").distinct(), [key, "image_id"], "left_semi")
    pref = F.struct(F.col("heading").rlike(least).alias("overview"), (~F.col("heading").rlike(preferred)).alias("other"), "line_no", "i")
    best = c.groupBy(key, "image_id").agg(F.min(pref).alias("p"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("p"))).where(F.col("n") <= most)
    return best.select(key, "image_id", F.col("p.line_no").alias("at"))


def abbreviated(text: Column, names: dict[str, str]) -> Column:
    """Source names shortened where they stand in a citation: after （ or ；, before ）, ； or a slash; longer names first."""
    for name in sorted((n for n in names if n and names[n]), key=len, reverse=True):
        for a in ("（", "；"):
            for b in ("）", "；", " /"):
                text = F.replace(text, F.lit(a + name + b), F.lit(a + names[name] + b))
    return text


def clean_points(points: Column, most: int = 5, longest: int = 80) -> Column:
    """The first non-blank points; one too long without its bold marks is cut and loses them."""
    plain = lambda x: F.replace(x, F.lit("**"), F.lit(""))
    kept = F.filter(F.transform(points, lambda x: F.trim(x)), lambda x: x.isNotNull() & (plain(x) != ""))
    return F.slice(F.transform(kept, lambda x: F.when(F.length(plain(x)) <= longest, x).otherwise(F.substring(plain(x), 1, longest))), 1, most)


def claims(df: DataFrame, key: str, text: str, most: int = 12) -> DataFrame:
    """key, pos, claim: bullets that claim something, citation tails cut, each once, the first ``most``."""
    from quaylight.sources.exports import lines

    rows = lines(df.select(key, text), text).where(F.col("line").rlike(r"^-\s+.+$"))
    title = F.regexp_extract("line", r"^-\s+\*\*([^*]+)\*\*[：:]", 1)
    body = F.regexp_replace("line", r"^-\s+(?:\*\*[^*]+\*\*[：:])?", "")
    q = F.trim(F.regexp_replace(F.trim(F.concat_ws(" ", F.trim(title), F.trim(body))), r"（[^）]+ / \d{2}:\d{2}[^）]*）$", ""))
    rows = rows.select(key, "line_no", q.alias("claim")).where(markup.is_claim(F.col("claim")))
    rows = rows.groupBy(key, "claim").agg(F.min("line_no").alias("line_no"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("pos") <= most)
    return rows.select(key, "pos", "claim")


def message_html(text: Column) -> Column:
    """Headings and bold as <b>, bullets as •, all else escaped, line by line."""
    bold = lambda x: F.regexp_replace(markup.escaped_html(x), r"\*\*(.+?)\*\*", "<b>$1</b>")

    def one(x: Column) -> Column:
        x = F.rtrim(x)
        heading, bullet = F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1), F.regexp_extract(x, r"^\s*[-*]\s+(.+)$", 1)
        return F.when(heading != "", F.concat(F.lit("<b>"), bold(F.trim(heading)), F.lit("</b>"))).when(bullet != "", F.concat(F.lit("• "), bold(F.trim(bullet)))).otherwise(bold(x))

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def without_false_quotes(intro: Column, quotes: Column) -> Column:
    """「…」 stays only around a verified quote, white space aside."""
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    spans = F.regexp_extract_all(intro, F.lit("「([^」]*)」"), F.lit(1))
    false = F.filter(spans, lambda s: ~F.exists(quotes, lambda q: bare(q) == bare(s)))
    return F.reduce(false, intro, lambda t, s: F.replace(t, F.concat(F.lit("「"), s, F.lit("」")), s))


def prompts(df: DataFrame, key: str, order: str, line: Column, head: str) -> DataFrame:
    """key, prompt: the ordered lines of a key under a heading."""
    lines_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(lines_, lambda x: x["l"]), "\n")).alias("prompt"))


def suggested_thresholds(judged: DataFrame, band: str, low: str, same: Column) -> DataFrame:
    """candidate, strong: the lowest band bounds at which half and nine tenths of the judged pairs are the same event."""
    g = judged.groupBy(band, low).agg(F.avg(same.cast("double")).alias("rate"))
    return g.agg(F.min(F.when(F.col("rate") >= 0.5, F.col(low))).alias("candidate"), F.min(F.when(F.col("rate") >= 0.9, F.col(low))).alias("strong"))


def first_heads(order: list, titles: list[str], threshold: float) -> list:
    """For each title the order value of the first head similar enough, else its own.

    The matching-blocks ratio is at most twice the shared characters over both lengths, so heads under that bound are
    passed over; shared characters are counted through postings of the heads' characters.
    """
    heads: list[tuple] = []
    lengths = array("l")
    postings: dict[tuple[str, int], array] = defaultdict(lambda: array("l"))
    known: dict[str, object] = {}
    out = []
    for o, s in zip(order, titles):
        if s not in known:
            count: Counter = Counter()
            tokens = []
            for c in s:
                tokens.append((c, count[c]))
                count[c] += 1
            near: list[int] = []
            if heads:
                lists = [np.frombuffer(postings[t], dtype="l") for t in tokens if t in postings]
                shared = np.bincount(np.concatenate(lists), minlength=len(heads)) if lists else np.zeros(len(heads), int)
                del lists  # the postings can't grow while they are viewed
                near = np.nonzero(2 * shared >= threshold * (np.array(lengths) + len(s)) - 1e-9)[0].tolist()
            known[s] = next((heads[j][0] for j in near if SequenceMatcher(None, heads[j][1], s).ratio() >= threshold), o)
            if known[s] == o:
                for t in tokens:
                    postings[t].append(len(heads))
                heads.append((o, s))
                lengths.append(len(s))
        out.append(known[s])
    return out


def merged_by_title(df: DataFrame, group: str, order: str, title: str, threshold: float = 0.65) -> DataFrame:
    """Rows with ``head``: the order value of the first row of their group whose title is similar enough, taken in order.

    A group is one task's work: the rule compares with heads in order.  Titles of one group are bounded by what a
    category holds; equal titles are decided once, and only heads that share enough characters are compared.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(head=first_heads(pdf[order].tolist(), ["".join(t.split()).lower() for t in pdf[title].fillna("")], threshold))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(group).applyInPandas(run, f"{kinds}, head {df.schema[order].dataType.simpleString()}")


def with_model(df: DataFrame, text: str, model: Callable[[list[str]], list], out: str, kind: str, batch: int = 100) -> DataFrame:
    """``df`` with ``out`` from a plug-in model called with at most ``batch`` texts at a time; a failing call gives nulls.

    The model is any picklable function of a list of texts: an embedder, a judge, a summariser. Nothing here
    calls a network.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {kind}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got: list = []
            for lo in range(0, len(pdf), batch):
                part = pdf[text].iloc[lo : lo + batch].fillna("").tolist()
                try:
                    res = list(model(part))
                    got += res if len(res) == len(part) else [None] * len(part)
                except Exception:  # noqa: BLE001
                    got += [None] * len(part)
            pdf[out] = pd.Series(got, index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(run, schema)
