"""Latest-row, ranking, merge and journal patterns, shared by the queries. All are pure, and lazy but for the chains."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import Scratch


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, e.g. F.desc("measured_at"), F.desc("id"). Null keys form their own group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of df with no partner; unlike NOT IN a null key has none and stays."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def with_partner(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """J4."""
    return df.join(other.select(*on), list(on), "left_semi")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], replace: Sequence[str]) -> DataFrame:
    """Rows of both; the columns of `replace` come from incoming where it has the key, the others stay as they are."""
    a, b = current.alias("a"), incoming.withColumn("_in", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    cols = []
    for c in current.columns:
        if c in keys or c not in incoming.columns:
            cols.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in incoming.columns else F.col(f"a.{c}").alias(c))
        elif c in replace:
            cols.append(F.when(F.col("b._in"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            cols.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c))
    return joined.select(*cols)


def versions(arrivals: DataFrame, keys: Sequence[str], order: Sequence[str], body: str) -> DataFrame:
    """Arrivals that change the body against the one before of the same key, with the version number; repeats are no-ops."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = arrivals.withColumn("_before", F.lag(body).over(w)).withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) | ~F.col("_before").eqNullSafe(F.col(body)))
    return changed.withColumn("version", F.row_number().over(w)).drop("_before", "_rn")


def changes(journal: DataFrame, keys: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """Journal rows whose values differ from the row before of the same key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*values)
    return journal.withColumn("_last", F.lag(now).over(w)).where(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(now)).drop("_last")


def resolve_chains(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target) with chains followed to their ends, by doubling until a round changes nothing; links must lead to smaller numbers, so there are no cycles.

    One row per source is expected; of several the least target counts.
    """
    now = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(target) < F.col(source))).groupBy(source).agg(F.min(target).alias(target))
    scratch = Scratch(pairs.sparkSession, "chains")
    now, k = scratch.write(now, "links0"), 0
    while True:
        nxt = now.select(F.col(source).alias(target), F.col(target).alias("_end"))
        step = now.join(nxt, target, "left").select(source, F.coalesce("_end", target).alias(target), F.col("_end").isNotNull().alias("_moved"))
        k += 1
        step = scratch.write(step, f"links{k}")
        scratch.drop(f"links{k - 1}")
        now = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return now


def nearest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, *cols: str) -> DataFrame:
    """For each left row the last right row of the same key strictly before it (as-of); union and one window, no range join."""
    tagged = right.select(*keys, F.col(right_at).alias("_at"), F.struct(*cols).alias("_row"), F.lit(1).alias("_side"))
    asked = left.select(*keys, F.col(left_at).alias("_at"), F.struct(*left.columns).alias("_left"), F.lit(0).alias("_side"))
    both = tagged.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1)
    last = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_side = 0")
    return last.select("_left.*", *[F.col(f"_row.{c}").alias(f"last_{c}") for c in cols])


#: Query vectors that travel to the tasks at once, and rows of a task that meet them at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 8192


def nearest_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, score, rank): for each query its k rows of greatest cosine, itself left out; score has six digits, ties go to the smaller id.

    The queries go over all rows in blocks: each task keeps k rows a query of its own, and one
    window ranks what is left. Null vectors, and those of another length than a query's, take no
    part; a norm of 0 gives a cosine of 0.
    """
    spark = queries.sparkSession
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-q.count() // QUERY_BLOCK)))))
    found = None
    for b in range(max(1, q.agg(F.max("block")).first()[0] or 0) + 1 if not q.isEmpty() else 0):
        held = q.where(F.col("block") == b).select("id", "v").toArrow()  # about QUERY_BLOCK vectors
        if not held.num_rows:
            continue
        ids = held.column("id").to_numpy()
        vectors = [np.array(v, float) for v in held.column("v").to_pylist()]
        shared = spark.sparkContext.broadcast((ids, vectors))
        near = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_nearest(shared, k), "query_id bigint, id bigint, score double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    return top_k(found, ["query_id"], k, F.desc("score"), F.col("id"))


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        best: dict[int, list[tuple[float, int]]] = {}
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1.0)
        sizes = {len(v) for v in vectors}
        groups = {s: ([i for i, v in enumerate(vectors) if len(v) == s], unit(np.array([v for v in vectors if len(v) == s]).reshape(-1, s))) for s in sizes if s}
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                own, rows = part.column(0).to_numpy(), part.column(1).to_pylist()
                for size, (places, block) in groups.items():
                    pick = [i for i, v in enumerate(rows) if len(v) == size]
                    if not pick:
                        continue
                    row_ids = own[pick]
                    cos = np.round(block @ unit(np.array([rows[i] for i in pick], float)).T, 6)
                    for j, place in enumerate(places):
                        scores = np.where(row_ids == ids[place], -2.0, cos[j])
                        # all that reach the k-th score, so that ties are settled by id below
                        floor = np.partition(scores, -k)[-k] if len(scores) > k else -2.0
                        hit = np.flatnonzero((scores >= floor) & (scores > -2))
                        merged = best.get(place, []) + [(-float(scores[i]), int(row_ids[i])) for i in hit]
                        best[place] = sorted(merged)[:k]
        out = [(int(ids[p]), i, -s) for p, rows_ in best.items() for s, i in rows_]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "id", "score"])

    return run


def hamming_pairs(df: DataFrame, key: str, value: str, most: int = 6, within: str | None = None) -> DataFrame:
    """(a, b, distance) of rows whose 64-bit values differ in at most `most` bits, a < b; within: a column they must share.

    Pigeonhole: of most // 2 + 1 chunks one differs in a single bit at most, so each value is looked
    up under its chunks and under every chunk with one bit changed, and no pair is lost. Rows of
    the same value are joined as values first; null keys and values take no part.
    """
    chunks = max(2, most // 2 + 1)
    ends = [round(64 * i / chunks) for i in range(chunks + 1)]
    group = F.lit(0) if within is None else F.col(within)
    known = df.where(F.col(key).isNotNull() & F.col(value).isNotNull() & group.isNotNull()).select(group.alias("g"), F.col(key).alias("k"), F.col(value).alias("v")).distinct()
    values = known.select("g", "v").distinct()
    bits = lambda lo, hi: F.shiftrightunsigned(F.shiftleft("v", 64 - hi), 64 - hi + lo)
    exact = F.array(*[F.struct(F.lit(i).alias("chunk"), bits(lo, hi).alias("bits")) for i, (lo, hi) in enumerate(zip(ends, ends[1:]))])
    flips = [F.struct(F.lit(i).alias("chunk"), bits(lo, hi).bitwiseXOR(F.lit(m)).alias("bits")) for i, (lo, hi) in enumerate(zip(ends, ends[1:])) for m in (0, *(1 << j for j in range(hi - lo)))]
    held = values.select("g", F.col("v").alias("vb"), F.explode(exact).alias("x")).select("g", "vb", "x.chunk", "x.bits")
    look = values.select("g", F.col("v").alias("va"), F.explode(F.array(*flips)).alias("x")).select("g", "va", "x.chunk", "x.bits")
    close = F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))) <= most
    near = look.join(held, ["g", "chunk", "bits"]).where((F.col("va") < F.col("vb")) & close).select("g", "va", "vb").distinct()
    all_ = near.unionByName(values.select("g", F.col("v").alias("va"), F.col("v").alias("vb")))
    ka, kb = known.select("g", F.col("k").alias("ka"), F.col("v").alias("va")), known.select("g", F.col("k").alias("kb"), F.col("v").alias("vb"))
    met = all_.join(ka, ["g", "va"]).join(kb, ["g", "vb"]).where((F.col("va") != F.col("vb")) | (F.col("ka") < F.col("kb")))
    return met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))).alias("distance"))


def exact_median(df: DataFrame, group: str, value: str, parts: int = 256) -> DataFrame:
    """A2: (group, median) without bringing a group's values together; nulls don't count.

    Approximate quantiles cut each group's values into parts; counts tell in which part the middle
    lies, and only that part's different values are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    cuts = rows.groupBy(group).agg(F.percentile_approx("_v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("_cuts"))
    placed = rows.join(cuts, group).select(group, "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part"))
    values = placed.groupBy(group, "_part", "_v").agg(F.count("*").alias("_n"))
    sizes = values.groupBy(group, "_part").agg(F.sum("_n").alias("_size"))
    by_part = Window.partitionBy(group).orderBy("_part")
    sizes = sizes.withColumn("_before", F.sum("_size").over(by_part) - F.col("_size")).withColumn("_all", F.sum("_size").over(Window.partitionBy(group)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = sizes.where((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low)).drop("_size")
    ranked = values.join(middle, [group, "_part"]).withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(group, "_part").orderBy("_v")))
    hits = lambda at: (F.col("_to") - F.col("_n") <= at) & (F.col("_to") > at)
    return ranked.groupBy(group).agg(((F.max(F.when(hits(low), F.col("_v"))) + F.max(F.when(hits(high), F.col("_v")))) / 2).alias("median"))


def prefixes(path: str | Column, limit: int = 5) -> Column:
    """All non-empty prefixes of an array."""
    p = F.col(path) if isinstance(path, str) else path
    return F.transform(F.sequence(F.lit(1), F.least(F.size(p), F.lit(limit))), lambda n: F.slice(p, 1, n))
