"""Queries of the operators for training data: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm import components, history, lines, mixing, neardup, packing, stuffing, vectors
from tidewire.session import table


def p1_found(spark, d):
    return components.event_groups(spark, table(spark, d, "merge_verdicts"))


def p1_groups(spark, d):
    return components.canonical_events(spark, table(spark, d, "merge_verdicts"), table(spark, d, "news_events"))


def p3_found(spark, d):
    return history.earlier_copies(spark, table(spark, d, "news_items"), table(spark, d, "raw_items")).select("old_id", "new_id")


def p4_found(spark, d):
    return neardup.similar_pairs(spark, table(spark, d, "news_items")).select("item_a", "item_b")


def p4_groups(spark, d):
    return neardup.similar_groups(spark, table(spark, d, "news_items"))


def p5_found(spark, d):
    return lines.repeated_lines(spark, table(spark, d, "news_items")).select("source_id", "line")


def p5_cleaned(spark, d):
    return lines.cleaned(spark, table(spark, d, "news_items"))


def p6_found(spark, d):
    return vectors.similar_stories(spark, table(spark, d, "stories"))


def p6_nearest(spark, d):
    return vectors.neighbours_of_sample(spark, table(spark, d, "stories"))


def p8_packed(spark, d):
    return packing.packed(spark, table(spark, d, "documents"), table(spark, d, "context_windows"))


def p8_fill(spark, d):
    return packing.fill_report(p8_packed(spark, d)).withColumn("fill", F.round("fill", 6))


def p9_mix(spark, d):
    return mixing.mixed(spark, table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_shares(spark, d):
    return mixing.mixed_shares(spark, table(spark, d, "documents"), table(spark, d, "source_targets"))


def p10_found(spark, d):
    return stuffing.stuffed_documents(spark, table(spark, d, "documents"))


def p10_scores(spark, d):
    return stuffing.stuffing_scores(spark, table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p4_found, p4_groups, p5_found, p5_cleaned, p6_found, p6_nearest, p8_packed, p8_fill, p9_mix, p9_shares, p10_found, p10_scores)}
