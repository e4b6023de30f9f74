"""Queries of the core: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import hierarchy, rolling
from tidewire.plans import analytics, cases, desk, editorial
from tidewire.session import table


def p2_found(spark, d):
    return hierarchy.hierarchy(spark, table(spark, d, "taxonomy_nodes")).select("node_id", "root_id", "node_depth")


def p2_paths(spark, d):
    paths = hierarchy.hierarchy(spark, table(spark, d, "taxonomy_nodes"))
    return paths.where("node_depth >= 0").select("node_id", "root_id", "node_depth", "descendants", F.concat_ws(" / ", "path_labels").alias("path"))


def p2_descendants(spark, d):
    return hierarchy.descendants(hierarchy.hierarchy(spark, table(spark, d, "taxonomy_nodes")))


def p2_all_paths(spark, d):
    """p2_paths for each node, those on cycles and below them included."""
    paths = hierarchy.hierarchy(spark, table(spark, d, "taxonomy_nodes"))
    return paths.select("node_id", "root_id", "node_depth", "descendants", F.concat_ws(" / ", "path_labels").alias("path"))


def p2_all_descendants(spark, d):
    """p2_descendants for each node, those on cycles and below them included."""
    return hierarchy.descendants(hierarchy.hierarchy(spark, table(spark, d, "taxonomy_nodes")), cyclic=True)


def p2_cycles(spark, d):
    return hierarchy.hierarchy(spark, table(spark, d, "taxonomy_nodes")).where("back_edge").select(F.col("node_id").alias("cycle_id"))


def p7_found(spark, d):
    return rolling.surges(rolling.rolling_totals(table(spark, d, "item_metrics")))


def p7_rolling(spark, d):
    t = rolling.rolling_totals(table(spark, d, "item_metrics"))
    avg = [F.round(c, 6).alias(c) for c in t.columns if "_avg_" in c]
    return t.select("item_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[c for c in t.columns if c.endswith(("_7d", "_30d")) and "_avg_" not in c], *avg)


QUERIES = analytics.QUERIES | {name: f for name, (f, _) in (editorial.BOTH | desk.BOTH | cases.BOTH).items()} | {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_all_paths, p2_all_descendants, p2_cycles, p7_found, p7_rolling)}
