"""Views of the domain tables in the roles that they have no table for, in Spark and in SQL.

Posts are linked to events by day: the posts of a UTC day are dealt to the events first seen on
it by id, so that an event has posts of several sources and the number of links is at most that
of the posts. Publications follow from what the editors chose (curated), image records from posts
of albums, subscribers from the views of a source's posts on a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.plans import adapters as A
from tidewire.plans.reference import EVENTS, ITEMS
from tidewire.session import table

NOW = "TIMESTAMP '2025-04-10 00:00:00'"

LINKS = f"""(WITH e AS (SELECT id, first_source_id, CAST(first_seen_at AS DATE) AS day, row_number() OVER (PARTITION BY CAST(first_seen_at AS DATE) ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY CAST(first_seen_at AS DATE)) AS m FROM {EVENTS} WHERE first_seen_at IS NOT NULL)
SELECT e.id AS event_id, i.id AS item_id, i.source_id, CASE WHEN i.source_id = e.first_source_id THEN 'origin' ELSE 'copy' END AS role FROM (SELECT DISTINCT day, m FROM e) c JOIN {ITEMS} i ON CAST(i.published_at AS DATE) = c.day JOIN e ON e.day = c.day AND e.k = i.id % c.m)"""
PUBS = f"""(SELECT id * 10 AS id, id AS event_id, story_id, title AS headline, CASE curated WHEN 'publish' THEN 'published' WHEN 'hold' THEN 'review' ELSE 'draft' END AS status, CASE WHEN curated = 'publish' THEN updated_at END AS published_at FROM {EVENTS} WHERE curated IS NOT NULL)"""
MEDIA = f"""(SELECT id * 10 + 1 AS id, id AS item_id, source_id, CASE WHEN id % 5 = 0 THEN 'video' ELSE 'image' END AS kind, CASE WHEN id % 5 <> 0 THEN printf('%016x', simhash) END AS phash, CAST(id % 1500 AS INT) AS width, id % 97 * 1000000 AS size_bytes,
 CASE WHEN status IN ('accepted', 'clustered') AND id % 3 <> 0 THEN 'media/' || id END AS storage_key, external_id AS source_ref, deleted_at AS purged_at, fetched_at AS first_seen_at FROM {ITEMS} WHERE grouped_id IS NOT NULL)"""
AUDIENCE = f"""(SELECT i.source_id, CAST(m.measured_at AS DATE) AS day, sum(m.views) AS subscribers FROM (SELECT DISTINCT id, item_id, measured_at, views FROM item_metrics WHERE views > 0) m JOIN {ITEMS} i ON i.id = m.item_id GROUP BY i.source_id, CAST(m.measured_at AS DATE))"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, item_id, source_id, role)."""
    by_day = Window.partitionBy("day")
    e = A.news_events(spark, d, "first_source_id", "first_seen_at").where("first_seen_at is not null").withColumn("day", F.to_date("first_seen_at"))
    e = e.select(F.col("id").alias("event_id"), "first_source_id", "day", (F.row_number().over(by_day.orderBy("id")) - 1).cast("bigint").alias("k"), F.count("*").over(by_day).alias("m"))
    i = A.items(spark, d, "source_id", "published_at").where("published_at is not null").select(F.col("id").alias("item_id"), "source_id", F.to_date("published_at").alias("day"))
    dealt = i.join(e.groupBy("day").agg(F.max("m").alias("m")), "day").select("item_id", "source_id", "day", (F.col("item_id") % F.col("m")).alias("k"))
    role = F.when(F.col("source_id") == F.col("first_source_id"), "origin").otherwise("copy")
    return dealt.join(e.drop("m"), ["day", "k"]).select("event_id", "item_id", "source_id", role.alias("role"))


def publications(spark: SparkSession, d: str) -> DataFrame:
    e = A.news_events(spark, d, "story_id", "title", "curated", "updated_at").where("curated is not null")
    status = F.when(F.col("curated") == "publish", "published").when(F.col("curated") == "hold", "review").otherwise("draft")
    return e.select((F.col("id") * 10).alias("id"), F.col("id").alias("event_id"), "story_id", F.col("title").alias("headline"), status.alias("status"), F.when(F.col("curated") == "publish", F.col("updated_at")).alias("published_at"))


def media(spark: SparkSession, d: str) -> DataFrame:
    i = A.items(spark, d, "source_id", "grouped_id", "simhash", "status", "external_id", "deleted_at", "fetched_at").where("grouped_id is not null")
    stored = F.col("status").isin("accepted", "clustered") & (F.col("id") % 3 != 0)
    return i.select(
        (F.col("id") * 10 + 1).alias("id"), F.col("id").alias("item_id"), "source_id", F.when(F.col("id") % 5 == 0, "video").otherwise("image").alias("kind"),
        F.when(F.col("id") % 5 != 0, F.lower(F.lpad(F.hex("simhash"), 16, "0"))).alias("phash"), (F.col("id") % 1500).cast("int").alias("width"), (F.col("id") % 97 * 1000000).alias("size_bytes"),
        F.when(stored, F.concat(F.lit("media/"), F.col("id").cast("string"))).alias("storage_key"), F.col("external_id").alias("source_ref"), F.col("deleted_at").alias("purged_at"), F.col("fetched_at").alias("first_seen_at"),
    )


def audience(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, day, subscribers)."""
    m = table(spark, d, "item_metrics").select("id", "item_id", "measured_at", "views").where("views > 0").distinct()
    per = m.groupBy("item_id", F.to_date("measured_at").alias("day")).agg(F.sum("views").alias("views"))  # the pinned post is summed before the join
    i = A.items(spark, d, "source_id").withColumnRenamed("id", "item_id")
    return per.join(i, "item_id").groupBy("source_id", "day").agg(F.sum("views").alias("subscribers"))
