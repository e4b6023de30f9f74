"""Scores, gates and label columns. Business thresholds are parameters with no defaults of meaning beyond the operators' own tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import col, strip


def engagement_rate(reactions: str | Column, forwards: str | Column, subscribers: str | Column) -> Column:
    """A3: (sum of reactions + 2 * forwards) / subscribers; null without a positive number of subscribers."""
    likes = F.coalesce(F.aggregate(F.map_values(col(reactions)), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0).cast("bigint"))
    total = likes + 2 * F.coalesce(col(forwards), F.lit(0)).cast("bigint")
    return F.when(col(subscribers) > 0, total / col(subscribers))


def recency_weight(at: str | Column, as_of: Column, halflife_hours: float) -> Column:
    """exp(-age / halflife), ages below 0 count as 0, a halflife of 0 or less gives 1."""
    if halflife_hours <= 0:
        return F.lit(1.0)
    hours = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(col(at))) / F.lit(3.6e9))
    return F.exp(-hours / F.lit(float(halflife_hours)))


def min_max(value: str | Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; one level gives 0.5."""
    return F.when(high > low, (col(value) - low) / (high - low)).otherwise(F.lit(0.5))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays; 0 if a norm is 0, null if either is null or the lengths differ."""
    x, y = col(a).cast("array<double>"), col(b).cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    n = norm(x) * norm(y)
    return F.when(F.size(x) == F.size(y), F.when(n > 0, dot / n).otherwise(F.lit(0.0)))


def band_label(x: str | Column, low: str = "low", mid: str = "medium", high: str = "high", none: str = "—") -> Column:
    """Thirds at 0.33 and 0.66; 0 and null have no label."""
    c = col(x)
    return F.when(c.isNull() | (c == 0), none).when(c >= 0.66, high).when(c >= 0.33, mid).otherwise(low)


def significance(parts: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """The weights of the parts that hold, summed and clamped to 0..1, and the sorted names of those parts."""
    total = F.lit(0.0)
    for holds, weight in parts.values():
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(holds, F.lit(n)) for n, (holds, _) in sorted(parts.items())]))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), names


#: Levels from least to worst.
LEVELS = ("low", "high", "critical")


def risk_level(rubrics: str | Column, levels: dict[str, str], default: str = "high") -> Column:
    """The worst level of the known rubrics, trimmed and lower-cased; the default if none is known."""
    rank = F.create_map(*[x for r, lv in levels.items() for x in (F.lit(r.strip().lower()), F.lit(LEVELS.index(lv)))])
    known = F.array_compact(F.transform(F.coalesce(col(rubrics), F.array().cast("array<string>")), lambda r: F.try_element_at(rank, F.lower(strip(r)))))
    out = F.lit(default)
    for i, name in enumerate(LEVELS):  # the last one that is there is the worst
        out = F.when(F.array_contains(known, i), F.lit(name)).otherwise(out)
    return out


def gate_decision(
    level: str | Column, independent: str | Column, official: str | Column, first: str | Column, trusted: str | Column, rumor: str | Column, required: int = 2
) -> Column:
    """X11: (status, publishable, reason) by level and evidence; an unknown level raises. Null flags are false, a null count is 0.

    A rumour is labelled as one and goes out. Else an official or first-hand source confirms. High
    and critical levels are reported from `required` independent sources on, the low one from a
    single trusted source; what is left is a signal, which waits.
    """
    lv, n = col(level), F.coalesce(col(independent), F.lit(0))
    yes = lambda c: F.coalesce(col(c), F.lit(False))
    unknown = F.raise_error(F.concat(F.lit("unknown level: "), F.coalesce(lv, F.lit("null")))).cast("string")
    rules = (
        (yes(rumor), "rumor", "labelled as a rumor"),
        (yes(official) | yes(first), "confirmed", "official or first-hand source"),
        ((lv != "low") & (n >= required), "reported", "independent sources"),
        ((lv == "low") & yes(trusted), "reported", "trusted source"),
        (lv == "low", "signal", "needs a trusted source"),
    )
    status, reason = F.lit("signal"), F.lit("needs a second or first-hand source")
    for holds, name, why in reversed(rules):
        status, reason = F.when(holds, name).otherwise(status), F.when(holds, why).otherwise(reason)
    status = F.when(F.coalesce(~lv.isin(*LEVELS), F.lit(True)), unknown).otherwise(status)
    return F.struct(status.alias("status"), (status != "signal").alias("publishable"), reason.alias("reason"))


def blocked_reasons(**checks: Column) -> Column:
    """the sorted names of all failing checks; null checks don't fail."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(checks.items())]))))


def decision(entity: str, entity_id: str | Column, stage: str, verdict: str | Column, reason: str | Column, at: Column) -> Column:
    """One uniform journal row; entity ids are strings."""
    v = F.lit(verdict) if isinstance(verdict, str) else verdict
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        F.lit(entity).alias("entity_type"), col(entity_id).cast("string").alias("entity_id"), F.lit(stage).alias("stage"), v.alias("decision"), r.alias("reason"), at.alias("created_at")
    )
