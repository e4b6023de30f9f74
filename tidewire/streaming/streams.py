"""Incremental forms: albums by session window, versions by state, metrics by watermark, and a micro-batch driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERSIONS = "source_id bigint, external_id string, id bigint, content_hash string, version int"


def albums(posts: DataFrame, gap_seconds: float = 2.0, watermark: str = "1 minute") -> DataFrame:
    """Posts of one grouped_id that arrive within gap_seconds of each other become one item.

    posts: (id, grouped_id, arrived_at, text). The item has the least id, the first non-blank
    caption and the number of parts. A post exactly gap_seconds later starts the next album, hence
    the gap less a microsecond. Works on batch and streaming frames; a streaming one emits an
    album once the watermark has passed it.
    """
    known = posts.where(F.col("grouped_id").isNotNull())
    if posts.isStreaming:
        known = known.withWatermark("arrived_at", watermark)
    caption = F.min_by("text", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("id")))
    window = F.session_window("arrived_at", f"{int(gap_seconds * 1e6) - 1} microseconds")
    return known.groupBy("grouped_id", window).agg(F.min("id").alias("id"), F.count("*").alias("parts"), caption.alias("caption")).select(
        "grouped_id", F.col("session_window.start").alias("first_at"), "id", "parts", "caption"
    )


def _versions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, number = state.get if state.exists else (None, 0)
    for batch in batches:
        rows = []
        for r in batch.sort_values("id").itertuples():
            if number == 0 or r.content_hash != last:
                number += 1
                last = r.content_hash
                rows.append((key[0], key[1], r.id, r.content_hash, number))
        state.update((last, number))
        yield pd.DataFrame(rows, columns=["source_id", "external_id", "id", "content_hash", "version"])


def version_stream(arrivals: DataFrame) -> DataFrame:
    """T1 as a stream: arrivals (source_id, external_id, id, content_hash) that change the body of their post, with the version number.

    State is one hash and one number per post. Within a micro-batch arrivals count in the order of their ids.
    """
    keyed = arrivals.select(F.col("source_id").cast("bigint").alias("source_id"), "external_id", "id", "content_hash")
    return keyed.groupBy("source_id", "external_id").applyInPandasWithState(_versions, VERSIONS, "last string, number int", "append", GroupStateTimeout.NoTimeout)


def windowed_engagement(polls: DataFrame, size: str = "1 day", late: str = "3 days") -> DataFrame:
    """Views and forwards per item and window; polls up to `late` behind the newest still count. Negative and null counts are 0."""
    rows = polls.withWatermark("measured_at", late) if polls.isStreaming else polls
    count = lambda c: F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")).alias(c)
    return rows.groupBy("item_id", F.window("measured_at", size).alias("w")).agg(count("views"), count("forwards"), F.count("*").alias("polls")).select(
        "item_id", F.col("w.start").alias("from_at"), "views", "forwards", "polls"
    )


def in_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, query: str):
    """Runs step on every micro-batch, once each by its number: a step must write by that number to be repeatable."""
    return stream.writeStream.queryName(query).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def routed(operations: DataFrame) -> dict[str, DataFrame]:
    """A stream of operations by its `op`: new and edited posts are upserts, deletions mark, album parts wait for their album."""
    op = F.lower(F.trim("op"))
    whole = operations.where(op.isin("new", "edit") & (F.col("grouped_id").isNull() | (op == "edit")))
    return {"upsert": whole, "delete": operations.where(op == "delete"), "album": operations.where((op == "new") & F.col("grouped_id").isNotNull())}
