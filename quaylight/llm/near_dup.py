"""Groups of texts that differ by small edits.

``near_copies`` folds exact copies, links the representatives and leaves the members
beside the links; ``classes`` gives each record its class; ``expanded_pairs`` lists all pairs of records.

Defined results: texts are compared without white space and in lower case by their sets of
runs of four characters; a text under ``MIN_CHARS`` characters then, null or empty has no
partner; rows that occur twice in full (same key, same text) count once; rows of one key with
different texts are all compared, never with each other; a null key takes no part; long
texts are compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.minhash import verified_links
from quaylight.session import materialize

MIN_CHARS = 40


@dataclass
class NearCopies:
    """members (id, rep, copies); links (a, b, similarity) between representatives, a < b."""

    members: DataFrame
    links: DataFrame


def squeezed_col(text: Column) -> Column:
    """``squeezed`` of a column: white space of all scripts and the four separators of ASCII are dropped, the rest is in lower case."""
    return F.lower(F.regexp_replace(text.cast("string"), r"(?U)[\s\x1c-\x1f]+", ""))


def near_copies(df: DataFrame, key: str, text: Column, threshold: float, min_chars: int = MIN_CHARS) -> NearCopies:
    """Members and links of the texts of ``df``; representatives and members are written to the shared folder."""
    rows = df.select(F.col(key).cast("long").alias("id"), squeezed_col(text).alias("squeezed")).where(F.col("id").isNotNull() & (F.length("squeezed") >= min_chars))
    rows = materialize(rows.withColumn("digest", F.unhex(F.md5("squeezed"))), "texts")
    reps = rows.groupBy("digest").agg(F.min("id").alias("id"), F.first("squeezed").alias("squeezed"), F.count("*").alias("copies"))
    # a key whose rows hold different texts may stand for several of them: nodes get numbers of their own, fixed once they are written
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    links = verified_links(reps.select(F.col("node").alias("id"), "squeezed"), threshold)
    members = rows.select("id", "digest").distinct().join(reps.select("digest", F.col("node").alias("rep")), "digest").select("id", "rep")
    return NearCopies(members, materialize(links, "links"))


def expanded_pairs(n: NearCopies) -> DataFrame:
    """All pairs id_a < id_b of records whose texts are equal or linked, copies included.

    Its size is that of the answer: quadratic in a group of copies. Members of a hot group
    are spread by the adaptive skew handling of the joins.
    """
    m = n.members
    equal = m.groupBy("rep").count().where("count > 1").select("rep")
    same = m.join(equal, "rep", "left_semi")
    pairs = same.select("rep", F.col("id").alias("x")).join(same.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    cross = n.links.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").where("x <> y").select("x", "y")
    both = pairs.unionByName(cross)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each component of the edges (a, b).

    Rounds of large-star and small-star: every node's larger neighbours are tied to its smallest one, then its
    smaller ones.  Edges never grow in number, no node's neighbours are gathered, and
    each round's edges are a table in the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = both.join(low, "a")
        if large:
            return j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    cur, before = edges.select("a", "b").where("a <> b"), None
    for _ in range(most_rounds):
        cur = materialize(star(star(cur, True), False), "stars")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def classes(n: NearCopies, df: DataFrame, key: str) -> DataFrame:
    """key, class_id, links: one row a key; its class is named by its smallest member, ``links`` counts the other texts linked to its text.

    A key with different texts takes the smallest of its classes; one without comparable text is a class of its own.
    """
    roots = components(n.links).select(F.col("node").alias("rep"), "root")
    both = n.links.select(F.col("a").alias("rep")).unionByName(n.links.select(F.col("b").alias("rep")))
    m = n.members.join(roots, "rep", "left").join(both.groupBy("rep").agg(F.count("*").alias("links")), "rep", "left")
    m = materialize(m.select("id", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    named = m.groupBy("root").agg(F.min("id").alias("class_id"))
    per = m.join(named, "root").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    ids = df.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    return ids.join(per, "id", "left").select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
