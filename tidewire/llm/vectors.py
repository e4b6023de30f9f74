"""Problem 6: the most similar vectors of every vector.

Method: all pairs, in blocks. The vectors are dealt to groups by a hash of their id, and each pair of
groups is a task. Products of matrices of 32 bits screen its pairs: what comes within SLACK of a
place among the k, or of the floor, is computed again in 64 bits, and ranked by that. So the rows
are those of a comparison of all with all, whatever the number of vectors; the number of groups
grows with it, and shows in nothing but the tasks.

The version before hashed (multiprobe, p-stable), with more functions and probes from 60,000 vectors
on: its rows hung on the number of vectors, and some were missed at any number.

Equal vectors are one: only their least id takes part, and the others come in at the end, so a
group of copies, however large, costs one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import Scratch, joined

DIMENSIONS = 64
K = 10
#: Vectors of a group, and the least number of groups, so that small tables use several tasks, too.
GROUP, LEAST = 60_000, 4
#: Rows and columns of one product.
TILE_Q, TILE_C = 256, 2048
#: By this much a cosine in 32 bits may be off: 64 products of unit vectors are within 1e-5.
SLACK = 4e-5


def vectors(rows: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v): one row per id with a usable vector as doubles: no nulls in it, the right length, not all zero."""
    v = F.col(vector).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) == dimensions) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(key).isNotNull() & usable).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.min(v).alias("v"))


def _best(r: np.ndarray, cosine: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k greatest of each r are; among equals the smaller id."""
    order = np.lexsort((ids, -cosine, r))
    r = r[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    begin = np.flatnonzero(new)
    return order[np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r)))) < k]


def _exact(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Cosines of the rows `at` of x and `to` of y; a pair has the same one in any block and either way round."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    out = np.empty(len(at))
    for k in range(0, len(at), 65_536):
        i, j = at[k : k + 65_536], to[k : k + 65_536]
        out[k : k + 65_536] = (x[i] * y[j]).sum(axis=1) / (nx[i] * ny[j])
    return out


def _pairs(x: np.ndarray, xid: np.ndarray, y: np.ndarray, yid: np.ndarray, k: int, floor: float | None, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, c, cosine): of each row of x the k most similar of y, of at least floor; both: the other way round, too."""
    unit = lambda v: np.nan_to_num(v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    ux, uy = unit(x), unit(y)
    found: list[tuple] = []
    for i in range(0, len(x), TILE_Q):
        own: list[tuple] = []
        least = np.full(min(TILE_Q, len(x) - i), -np.inf if floor is None else floor - SLACK, np.float32)
        for j in range(0, len(y), TILE_C):
            cos = ux[i : i + TILE_Q] @ uy[j : j + TILE_C].T
            if floor is None and cos.shape[1] > k:  # the k-th greatest of any columns is a bound for all
                least = np.maximum(least, np.partition(cos, -k, axis=1)[:, -k] - SLACK) if not j else least
            r, c = np.divmod(np.flatnonzero(cos >= least[:, None]), cos.shape[1])
            if len(r) == 0:
                continue
            value = _exact(x[i : i + TILE_Q], y[j : j + TILE_C], r, c)
            if floor is not None:
                r, c, value = (z[value >= floor] for z in (r, c, value))
            q, o = xid[i + r], yid[j + c]
            at = _best(q, value, o, k)
            own.append((q[at], o[at], value[at]))
            if both:
                at = _best(o, value, q, k)
                found.append((o[at], q[at], value[at]))
        if own:
            q, o, value = (np.concatenate(z) for z in zip(*own))
            at = _best(q, value, o, k)
            found.append((q[at], o[at], value[at]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q, o, value = (np.concatenate(z) for z in zip(*found))
    at = _best(q, value, o, k)
    return q[at], o[at], value[at]


def _compared(asked: DataFrame, all_: DataFrame, n_asked: int, n: int, k: int, floor: float | None, group: int, same: bool, kind: str) -> DataFrame:
    """(q, c, cosine): of each asked vector the k most similar in each group of all_. same: asked is all_, and no vector is its own."""
    halves = same and floor is not None
    rows = max(LEAST, math.ceil(n / group))
    lines = rows if same else math.ceil(max(n_asked, 1) / group)
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    v = F.col("v").cast(f"array<{kind}>").alias("v")
    if halves:  # a pair of groups once, the lesser first
        other = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
        sides = all_.select("id", v, part(rows).alias("own")).select("id", "v", "own", other.alias("other"))
        sides = sides.select((F.least("own", "other") * rows + F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "v")
    else:
        look = asked.select("id", v, part(lines).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("other")).select((F.col("own") * rows + F.col("other")).alias("pair"), F.lit(0).alias("side"), "id", "v")
        held = all_.select("id", v, part(rows).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("other")).select((F.col("other") * rows + F.col("own")).alias("pair"), F.lit(1).alias("side"), "id", "v")
        sides = look.unionByName(held)

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, side = t["id"].to_numpy(), t["side"].to_numpy()
        pair = t["pair"][0].as_py()
        v = t["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        first = side == 0
        alone = halves and pair // rows == pair % rows
        second = first if alone else ~first
        # a vector may meet itself: one more place
        q, c, cosine = _pairs(v[first], ids[first], v[second], ids[second], k + 1, floor, halves and not alone)
        other = q != c if same else np.ones(len(q), bool)
        return pa.table({"q": pa.array(q[other], pa.int64()), "c": pa.array(c[other], pa.int64()), "cosine": pa.array(cosine[other], pa.float64())})

    return sides.groupBy("pair").applyInArrow(compare, "q bigint, c bigint, cosine double")


def nearest(
    spark: SparkSession, rows: DataFrame, key: str, vector: str, *, k: int = K, code_bits: int | None = None, floor: float | None = None,
    queries: DataFrame | None = None, dimensions: int = DIMENSIONS, hot: int = GROUP,
) -> DataFrame:
    """(q, c, cosine, rank): for each query the k most similar other vectors.

    queries: (id, v) as of vectors(); all vectors if left out. floor: only pairs of at least this
    cosine. hot: vectors of a group; code_bits has no effect any more, as nothing is dropped before
    the exact ranking. Ties go to the smaller id. Vectors that are null, of another length, all
    zero or hold nulls take no part; an empty table gives no rows.
    """
    scratch = Scratch(spark, "nearest")
    rows_ = scratch.write(vectors(rows, key, vector, dimensions), "rows")
    same = rows_.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    all_ = scratch.write(same, "vectors")
    copies = all_.where("n > 1")
    copied = not copies.isEmpty()
    asked = all_.select("id", "v") if queries is None else scratch.write(queries.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "asked")
    count = all_.count()
    narrow = queries is None and rows.select(vector).dtypes[0][1] == "array<float>"
    compared = _compared(asked, all_, count if queries is None else asked.count(), count, k, floor, hot, queries is None, "float" if narrow else "double")
    scored = scratch.write(compared, "scored")
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "c")
    if copied:
        # of each group of copies the k + 1 least ids can be neighbours; every copy asks as its group does
        members = joined(rows_, copies.select("v", F.col("id").alias("class")), "v").select("class", "id")
        salted = Window.partitionBy("class", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
        first = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
        first = first.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("class").alias("c"), F.col("id").alias("member"))
        asking = members.select(F.col("class").alias("q"), F.col("id").alias("asker"))
        if queries is None:
            own = all_.select(F.col("id").alias("q"), F.col("id").alias("c"))
            mine = all_.where("n = 1").select(F.col("id").alias("q"), F.col("id").alias("asker")).unionByName(asking)
        else:
            own = asked.select(F.col("id").alias("q"), "v").join(all_.select("v", F.col("id").alias("c")), "v").select("q", "c")
            mine = asked.select(F.col("id").alias("q"), "v").join(queries.select("v", F.col("id").alias("asker")), "v").select("q", "asker")
        own_copies = own.join(copies.select(F.col("id").alias("c")), "c", "left_semi").select("q", "c", F.lit(1.0).alias("cosine"))
        scored = scored.join(own, ["q", "c"], "left_anti").unionByName(own_copies)
        scored = scored.join(first, "c", "left").select("q", F.coalesce("member", "c").alias("c"), "cosine")
        scored = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
        scored = mine.join(scored, "q").where("asker <> c").select(F.col("asker").alias("q"), "c", "cosine")
    elif queries is not None:
        scored = scored.where("q <> c")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_stories(spark: SparkSession, stories: DataFrame, floor: float = 0.9, k: int = K) -> DataFrame:
    """(story_a, story_b): pairs of at least floor in which one is among the other's k most similar."""
    near = nearest(spark, stories, "id", "centroid", k=k, floor=floor)
    return near.select(F.least("q", "c").alias("story_a"), F.greatest("q", "c").alias("story_b")).distinct()


def neighbours_of_sample(spark: SparkSession, stories: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """(story_id, neighbour_id, cosine, rank): the stated query set, ids divisible by `every`, against all rows."""
    asked = vectors(stories.where(F.col("id") % every == 0), "id", "centroid")
    near = nearest(spark, stories, "id", "centroid", k=k, queries=asked)
    return near.select(F.col("q").alias("story_id"), F.col("c").alias("neighbour_id"), "cosine", "rank")
