"""Video and article feeds: landed XML and JSON, as one row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.functions.coerce import epoch_seconds, iso_duration_seconds

ENTRY = (
    "`yt:videoId` string, title string, published string, author struct<name string, uri string>, "
    "`media:group` struct<`media:description` string, `media:thumbnail` struct<_url string>, `media:community` struct<`media:statistics` struct<_views bigint>>>"
)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files; broken entries have no id and are dropped."""
    rows = spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").schema(ENTRY).load(path)
    return rows.select(
        F.col("`yt:videoId`").alias("item_id"), F.lit("video").alias("kind"), F.trim("title").alias("title"), F.col("author.name").alias("author"),
        F.col("published").try_cast("timestamp").alias("published_at"), F.col("`media:group`.`media:description`").alias("description"),
        F.col("`media:group`.`media:thumbnail`._url").alias("cover"), F.col("`media:group`.`media:community`.`media:statistics`._views").alias("views"),
    ).where("item_id is not null and item_id <> ''")


def first_text(*cols: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed JSON pages; the list stands under ``articles`` or ``list``, publish times are epoch seconds."""
    item = "struct<id bigint, bv_id string, title string, pubtime string, duration string, cover string, image_urls array<string>, upper struct<name string, mid bigint>, cnt_info struct<play bigint>>"
    page = spark.read.schema(f"articles array<{item}>, list array<{item}>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = page.select(F.explode(F.coalesce("articles", "list")).alias("i"))
    cover = first_text(F.col("i.cover"), F.get(F.filter("i.image_urls", lambda x: F.trim(x) != ""), 0))
    return rows.select(
        F.coalesce("i.bv_id", F.col("i.id").cast("string")).alias("item_id"), F.when(F.col("i.bv_id").isNotNull(), "video").otherwise("article").alias("kind"), F.trim("i.title").alias("title"), F.col("i.upper.name").alias("author"),
        epoch_seconds(F.col("i.pubtime")).alias("published_at"), iso_duration_seconds(F.col("i.duration")).alias("seconds"), cover.alias("cover"), F.col("i.cnt_info.play").alias("views"),
    ).where("item_id is not null and title <> ''")


def unseen_since(items: DataFrame, seen: DataFrame, cutoff: Column, blocked: DataFrame | None = None) -> DataFrame:
    """Items neither seen nor older than the cutoff; without a time they stay. Blocked authors are left out."""
    out = items.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff)).join(seen.select("item_id"), "item_id", "left_anti")
    return out if blocked is None else out.join(blocked.select("author"), "author", "left_anti")


def united(*feeds: DataFrame) -> DataFrame:
    """All feeds under one another by column name, missing columns null."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def enriched(items: DataFrame, details: DataFrame) -> DataFrame:
    """Items with the duration of their detail row, where there is one."""
    d = details.groupBy("item_id").agg(F.max("seconds").alias("__s"))
    have = F.col("seconds") if "seconds" in items.columns else F.lit(None).cast("bigint")
    return items.join(d, "item_id", "left").withColumn("seconds", F.coalesce(F.col("__s"), have)).drop("__s")
