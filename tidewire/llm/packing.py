"""Problem 8: items of varying length into containers of fixed capacity.

Method: minimum bin slack. A container starts with the longest length left; a subset-sum over
the multiset of the lengths left (bitsets, one per length and binary part of its count) finds
the filling closest to the capacity, and the way back through the bitsets gives how many items
of each length it takes. A filling is repeated for as many containers as the counts allow, so
the plan works on the table of lengths (at most `capacity` rows, however many items there are)
and has about as many entries as there are different lengths.

Items are only touched twice, in parallel: to count their lengths, and to look up their
container by their rank among the items of their length. Ranks come from counts per block of a
hash of the item, so the items of one length, however many, are never sorted in one task.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import tokenizer
from tidewire.session import Scratch, small_side

#: Blocks over which the items of a length are ranked, at least, and items for which there is one more; a block of a length is sorted by one task.
BLOCKS, BLOCK_ROWS = 256, 1_000_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many items of each length fill room best: the largest reachable total, longer items first among equals.

    Subset-sum by bitsets: bit s of `reach` is set when total s can be made. It stops at the
    first length with which the room is filled exactly.
    """
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(filling, containers): fillings and how many containers get each, until no item is left."""
    left = {k: v for k, v in counts.items() if v}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    out: list[tuple[dict[int, int], int]] = []
    order = sorted(left)
    while order:
        longest = order[-1]
        rest = left | {longest: left[longest] - 1}
        used = Counter(fill({k: v for k, v in rest.items() if v}, capacity - longest))
        used[longest] += 1
        times = min(left[k] // n for k, n in used.items())
        out.append((dict(used), times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        order = [k for k in order if k in left]
    return out


def pieces(sizes: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity, doc_id, piece, tokens): each item once per window, split only where it exceeds the capacity.

    Items without tokens, without id, or windows without a positive capacity give no row. windows
    is a parameter table of a few rows.
    """
    w = windows.where(F.col("window_name").isNotNull() & (F.col("capacity_tokens") > 0)).groupBy("window_name").agg(F.min("capacity_tokens").alias("capacity"))
    # a join of every item with every window is the result itself: one row per item and window
    own = sizes.where(F.col("doc_id").isNotNull() & (F.col("tokens") > 0)).select("doc_id", "tokens", F.lit(1).alias("one"))
    each = own.join(F.broadcast(w.withColumn("one", F.lit(1))), "one")
    full = (F.col("tokens") / F.col("capacity")).cast("bigint")
    return each.select(
        "window_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("tokens") / F.col("capacity")) - 1)).alias("piece"), "tokens", full.alias("full")
    ).select("window_name", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), F.when(F.col("piece") < F.col("full"), F.col("capacity").cast("bigint")).otherwise(F.col("tokens") - F.col("full") * F.col("capacity")).alias("tokens"))


def packed(spark: SparkSession, documents: DataFrame, windows: DataFrame, vocabulary: str = tokenizer.VOCABULARY, blocks: int | None = None) -> DataFrame:
    """(window_name, capacity, container, doc_id, piece, tokens): where each piece of each document goes, for every window.

    documents: (doc_id, text), doc_id unique (of repeated ids one counts); null and empty texts
    take no room and have no row. Containers are numbered from 0 in each window.
    """
    scratch = Scratch(spark, "packing")
    once = tokenizer.counted(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), "text", vocabulary)
    sizes = scratch.write(once.groupBy("doc_id").agg(F.max("tokens").alias("tokens")), "sizes")
    blocks = blocks or max(BLOCKS, -(-sizes.count() // BLOCK_ROWS))
    items = pieces(sizes, windows).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    items = scratch.write(items, "items")
    key = ["window_name", "tokens"]
    # bounded by windows x capacity x blocks, whatever the number of items; by length it is windows x capacity
    blocked = scratch.write(items.groupBy("window_name", "capacity", "tokens", "block").agg(F.count("*").alias("n")), "blocked")
    before = blocked.withColumn("offset", F.sum("n").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    lengths = blocked.groupBy("window_name", "capacity", "tokens").agg(F.sum("n").alias("n")).collect()
    tables: dict[tuple[str, int], dict[int, int]] = {}
    for r in lengths:
        tables.setdefault((r["window_name"], r["capacity"]), {})[r["tokens"]] = r["n"]
    rows = []
    for (name, capacity), counts in sorted(tables.items()):
        container, taken = 0, Counter()
        for filling, times in plan(counts, capacity):
            for length, each in filling.items():
                rows.append((name, length, taken[length], taken[length] + each * times, each, container))
                taken[length] += each * times
            container += times
    schema = "window_name string, tokens bigint, low bigint, high bigint, each int, first bigint"
    spans = spark.createDataFrame(pd.DataFrame(rows, columns=["window_name", "tokens", "low", "high", "each", "first"]), schema) if rows else spark.createDataFrame([], schema)
    # the spans of a length, as one array: a rank finds its span without a range join
    by_length = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("low", "high", "each", "first"))).alias("spans"))
    rank = F.row_number().over(Window.partitionBy("window_name", "tokens", "block").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("at", rank).join(before.select(*key, "block", F.coalesce("offset", F.lit(0)).alias("offset")), [*key, "block"])
    # at most windows x capacity rows: sent to the items, so that those of a popular length stay where they lie
    placed = ranked.join(small_side(by_length, len(rows)), key).withColumn("rank", F.col("at") + F.col("offset"))
    span = F.element_at(F.filter("spans", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), 1)
    return placed.withColumn("span", span).select(
        "window_name", "capacity", (F.col("span.first") + F.floor((F.col("rank") - F.col("span.low")) / F.col("span.each"))).cast("bigint").alias("container"), "doc_id", "piece", "tokens"
    )


def fill_report(placed: DataFrame) -> DataFrame:
    """(window_name, capacity, containers, pieces, tokens, fill): how full each window's containers are."""
    per = placed.groupBy("window_name", "capacity", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return per.groupBy("window_name", "capacity").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * F.first("capacity"))).alias("fill")
    )
