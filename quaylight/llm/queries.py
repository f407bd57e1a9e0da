"""Queries of the training-text problems, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    from quaylight.llm.tokens import encode

    return encode(table(spark, d, "documents"), "text", ["doc_id"])


@_query
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    from quaylight.llm.packing import pack_texts

    return pack_texts(table(spark, d, "documents"), "doc_id", "text")


@_query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which one is among the other's three most similar: tbl, id_a, id_b."""
    from quaylight.llm.neighbours import nearest, neighbour_pairs

    both = [neighbour_pairs(nearest(table(spark, d, t), k, "embedding")).select(F.lit(t).alias("tbl"), "id_a", "id_b") for t, k in (("chunks", "chunk_id"), ("delivered", "msg_id"))]
    return both[0].unionByName(both[1])


def _cards(spark: SparkSession, d: str) -> tuple:
    """Cards, their key, and the text by which they are compared."""
    from quaylight.functions.text import card_body_col

    missing = F.col("norm_text").isNull()
    return table(spark, d, "delivered"), "msg_id", F.when(missing, card_body_col(F.when(missing, F.col("text")))).otherwise(F.col("norm_text"))


@_query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cards that are alike: msg_id_a, msg_id_b."""
    from quaylight.llm.near_dup import expanded_pairs, near_copies

    return expanded_pairs(near_copies(*_cards(spark, d), 0.6)).select(F.col("id_a").alias("msg_id_a"), F.col("id_b").alias("msg_id_b"))


@_query
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each card with its class of near copies and its number of links: msg_id, class_id, links."""
    from quaylight.llm.near_dup import classes, near_copies

    cards, key, body = _cards(spark, d)
    return classes(near_copies(cards, key, body, 0.6), cards, key)


@_query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lost their end: doc_id."""
    from quaylight.llm.truncation import find_cut

    return find_cut(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


@_query
def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Cut documents by what shows it: reason, documents."""
    from quaylight.llm.truncation import find_cut

    return find_cut(table(spark, d, "documents"), "doc_id", "text").groupBy("reason").agg(F.count("*").alias("documents"))


@_query
def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates: source, records, cut, share."""
    from quaylight.llm.truncation import find_cut, share_by_source

    docs = table(spark, d, "documents")
    return share_by_source(docs, find_cut(docs, "doc_id", "text"), "doc_id", "source")


def pii_fields(spark: SparkSession, d: str) -> DataFrame:
    """Texts that may hold personal data: tbl, row_key, place, text."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("tbl"), F.col("source_id").alias("row_key"), F.lit("text").alias("place"), "text")
    leads = table(spark, d, "hot_leads").select(F.lit("hot_leads").alias("tbl"), F.col("id").alias("row_key"), F.lit("source_sender").alias("place"), F.col("source_sender").alias("text"))
    quotes = table(spark, d, "growth_segments").select("id", F.posexplode("quotes").alias("i", "q"))
    both = F.array(*[F.struct(F.concat(F.lit("quotes["), "i", F.lit(f"].{f}")).alias("place"), F.col(f"q.{f}").alias("text")) for f in ("text", "sender")])
    quotes = quotes.select("id", F.explode(both).alias("f")).select(F.lit("growth_segments").alias("tbl"), F.col("id").alias("row_key"), "f.place", "f.text")
    return chunks.unionByName(leads).unionByName(quotes)


@_query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in chunks, leads and quotes: tbl, row_key, place, kind, found_text."""
    from quaylight.llm.pii import findings, names_of

    return findings(pii_fields(spark, d), names_of(table(spark, d, "name_parts")))


@_query
def p6_redacted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts of chunks with placeholders: source_id, redacted."""
    from quaylight.llm.pii import names_of, redact

    return table(spark, d, "chunks").select("source_id", redact(F.col("text"), names_of(table(spark, d, "name_parts"))).alias("redacted"))


@_query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that repeat an accepted one: tbl, first_seq, seq; the backlog is worked in passes of whole batches of up to 50,000 rows."""
    return _linked(spark, d, 50_000)


@_query
def p2_one_by_one(spark: SparkSession, d: str) -> DataFrame:
    """The same with a pass for every batch, as they arrive."""
    return _linked(spark, d, 0)


def _linked(spark: SparkSession, d: str, rows: int) -> DataFrame:
    from quaylight.llm.linkage import History, catch_up, fingerprint_kind, video_kind

    names = ("content_seen", "bili_videos")
    links = catch_up(History(spark, [fingerprint_kind(names[0]), video_kind(names[1])]), [table(spark, d, t) for t in names], "batch_no", rows)
    return links.where("first_seq is not null").select(F.col("kind").alias("tbl"), "first_seq", "seq")



@_query
def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the search, for every twentieth vector against all: tbl, queries, wanted, hit, recall."""
    from quaylight.llm.neighbours import nearest, recall

    both = []
    for t, k in (("chunks", "chunk_id"), ("delivered", "msg_id")):
        rows = table(spark, d, t)
        both.append(recall(nearest(rows, k, "embedding"), rows, k, "embedding").select(F.lit(t).alias("tbl"), "queries", "wanted", "hit", "recall"))
    return both[0].unionByName(both[1])
