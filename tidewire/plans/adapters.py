"""Views of the driver's tables in the roles of the data model. Repeated rows count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import table


def once(df: DataFrame, key: str = "id") -> DataFrame:
    return df.dropDuplicates([key])


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources")


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """News items, each id once. Only the columns asked for are read, and shuffled to find repeated rows."""
    df = table(spark, d, "news_items")
    return once(df.select("id", *[c for c in columns if c != "id"]) if columns else df)


def derived(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    """What is derived of each news item, each id once: repeated rows are dropped after the projection, so texts aren't shuffled."""
    return once(table(spark, d, "news_items").select("id", *columns))


def news_events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, "news_events")
    return once(df.select("id", *[c for c in columns if c != "id"]) if columns else df)


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Engagement snapshots with item_id, measured_at, rubric, reactions, forwards and source_id, from the click events."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), F.col("ts").alias("measured_at"), F.col("event_type").alias("rubric"),
        F.map_from_arrays(F.array(F.lit("k")), F.array(F.get_json_object("props", "$.k").cast("int"))).alias("reactions"),
        F.floor("value").cast("int").alias("forwards"), ((F.col("user_id") % 10) + 1).alias("source_id"),
    )


def source_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Subscribers per source, from suppliers."""
    s = table(spark, d, "supplier")
    tiers = F.array(*[F.lit(x) for x in ("official", "media", "aggregator", "leak", "anonymous")])
    return s.select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.element_at(tiers, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("tier"),
        F.floor(F.abs("s_acctbal")).cast("int").alias("subscribers"),
    )


def journal(spark: SparkSession, d: str) -> DataFrame:
    """Reputation journal, from line items."""
    kinds = {"AF": "first", "NF": "confirmed", "NO": "copy", "RF": "refuted"}
    key = F.concat("l_returnflag", "l_linestatus")
    kind = F.coalesce(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])[key], F.lit("other"))
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"), kind.alias("kind"), F.col("l_shipdate").alias("at")
    )


def publications(spark: SparkSession, d: str) -> DataFrame:
    """Publications, from orders."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("story_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("priority")
    )
