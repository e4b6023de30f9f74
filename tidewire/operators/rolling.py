"""Problem 7: totals and averages over trailing periods, days without activity included.

Method: event-contribution deltas. A day's amount is added on its day and subtracted again when
it leaves the window, `days` later; the running sum of these deltas is the window's total. The
calendar days of an entity enter as zero deltas, so one running sum per entity over at most its
days serves every window, and no range frame is re-scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (7, 30)
METRICS = ("views", "forwards")


def daily_amounts(polls: DataFrame, entity: str = "item_id", at: str = "measured_at", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(entity, day, metrics...): per UTC day; the session's zone must be UTC.

    Rows of the same entity and time count once (where they differ, the one with the least id);
    a null or negative count is 0; rows without entity or time are dropped.
    """
    known = polls.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    counts = F.struct("id", *[F.greatest(F.coalesce(F.col(m), F.lit(0)), F.lit(0)).cast("bigint").alias(m) for m in metrics])
    # keyed by entity and time: a hot entity spreads over many tasks before it is summed by day
    once = known.groupBy(entity, at).agg(F.min(counts).alias("poll"))
    return once.groupBy(entity, F.to_date(at).alias("day")).agg(*[F.sum(f"poll.{m}").alias(m) for m in metrics])


def rolling_totals(
    polls: DataFrame,
    entity: str = "item_id",
    at: str = "measured_at",
    metrics: tuple[str, ...] = METRICS,
    windows: tuple[int, ...] = WINDOWS,
) -> DataFrame:
    """(entity, day, then <metric>_<w>d and <metric>_avg_<w>d): one row per entity and day between its first and last.

    A window ends with the day; only its days within the entity's span count, in sum and number.
    An empty table gives no rows. An entity's span is the calendar, so a partition of the running
    sum holds at most one row per day and boundary, however many polls an entity has.
    """
    daily = daily_amounts(polls, entity, at, metrics)
    spans = daily.groupBy(entity).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    names = [f"{m}_{w}d" for m in metrics for w in windows]

    def deltas(df: DataFrame, sign: int, after: int, of: int | None) -> DataFrame:
        cols = [(F.col(m) * sign if of is None or of == w else F.lit(0)).cast("bigint").alias(f"{m}_{w}d") for m in metrics for w in windows]
        return df.select(F.col(entity), F.date_add("day", after).alias("day"), *cols, F.lit(False).alias("shown"))

    calendar = spans.select(
        F.col(entity), F.explode(F.sequence("first", "last")).alias("day"), *[F.lit(0).cast("bigint").alias(n) for n in names], F.lit(True).alias("shown")
    )
    parts = deltas(daily, 1, 0, None).unionByName(calendar)
    for w in windows:
        parts = parts.unionByName(deltas(daily, -1, w, w))
    by_day = parts.groupBy(entity, "day").agg(*[F.sum(n).alias(n) for n in names], F.max("shown").alias("shown"))
    running = Window.partitionBy(entity).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    totals = by_day.select(
        entity, "day", "shown", *[F.sum(n).over(running).alias(n) for n in names], F.count(F.when(F.col("shown"), 1)).over(running).alias("days")
    ).where("shown")
    averages = [(F.col(f"{m}_{w}d") / F.least("days", F.lit(w))).alias(f"{m}_avg_{w}d") for m in metrics for w in windows]
    return totals.select(entity, "day", "days", *names, *averages)


def surges(totals: DataFrame, short: int = 7, long: int = 30, factor_num: int = 5, factor_den: int = 2, entity: str = "item_id") -> DataFrame:
    """(entity, on_day, metric_name) where the short mean is more than factor times the long one, compared in integers."""
    shown = []
    for m in METRICS:
        short_days, long_days = F.least("days", F.lit(short)), F.least("days", F.lit(long))
        more = F.col(f"{m}_{short}d") * long_days * factor_den > F.col(f"{m}_{long}d") * short_days * factor_num
        shown.append(F.when(more, F.lit(m)))
    return (
        totals.select(entity, F.date_format("day", "yyyy-MM-dd").alias("on_day"), F.explode(F.array_compact(F.array(*shown))).alias("metric_name"))
    )
