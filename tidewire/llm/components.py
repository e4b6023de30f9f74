"""Problem 1: groups of records from pairwise matches.

Method: low-diameter decomposition. Every vertex draws an exponential shift; the vertex with
the largest shift starts to grow a cluster first, and a cluster takes its neighbours one hop a
round. A vertex therefore ends in the cluster c that minimises hops(c, v) - shift(c). Clusters
are contracted to super-vertices, edges within a cluster vanish, and the same is done to the
edges between clusters until none is left. With rate BETA an edge is cut with probability of
about BETA, so the edges shrink geometrically and a few levels are enough at any size.

Growth is cut off after ROUNDS hops a level. That never joins what isn't linked (a vertex only
takes the centre of a neighbour); vertices out of reach stay their own centres and are
contracted on a later level, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import HOT_ROWS, Scratch, joined, small_side

BETA = 0.1
ROUNDS = 6
#: Neighbours of a vertex that one task looks up at most; a vertex with more is spread over salts.
HUB_DEGREE = 20_000
MATCHES = ("duplicate", "ingest_duplicate")


def match_pairs(verdicts: DataFrame) -> DataFrame:
    """(a, b) of the verdicts that are matches; null, 0 and missing ends are no matches."""
    action = F.lower(F.trim("action"))
    return verdicts.where(
        action.isin(*MATCHES) & F.col("event_id").isNotNull() & F.col("canonical_event_id").isNotNull() & (F.col("canonical_event_id") != 0)
    ).select(F.col("event_id").cast("bigint").alias("a"), F.col("canonical_event_id").cast("bigint").alias("b"))


def _undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges a < b without loops."""
    return (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _shift(vertex: str, level: int) -> F.Column:
    """Exponential with rate BETA, drawn from a hash of the vertex, so that every retry of a task draws the same."""
    u = (F.pmod(F.xxhash64(F.col(vertex), F.lit(level * 7919 + 17)), F.lit(1 << 52)) + F.lit(1)) / F.lit(float((1 << 52) + 1))
    return -F.log(u) / F.lit(BETA)


def decompose(scratch: Scratch, edges: DataFrame, level: int, rounds: int = ROUNDS, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(v, c): the cluster centre of every vertex of the undirected edges (a < b)."""
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    degree = scratch.write(both.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree")), f"degree{level}")
    labels = degree.select("v", (-_shift("v", level)).alias("start"), F.col("v").alias("c"))
    loops = degree.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("hop"))
    reach = both.withColumn("hop", F.lit(1)).unionByName(loops)
    # at most 2 * edges / hub_degree hubs, whose neighbours are spread over salts
    hubs = degree.where(F.col("degree") > hub_degree).select("v", F.ceil(F.col("degree") / F.lit(hub_degree)).cast("int").alias("salts"))
    hub = not hubs.isEmpty()
    if hub:
        hubs = scratch.write(hubs, f"hubs{level}")
        hubs = small_side(hubs, hubs.count())  # so that no hub's neighbours meet before they are salted
        of = hubs.withColumnRenamed("v", "src")
        reach = reach.join(of, "src", "left").withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")).select("src", "dst", "hop", "salt")
    for _ in range(rounds):
        if hub:
            copies = labels.join(hubs, "v", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
            met = reach.join(copies, (reach["src"] == copies["v"]) & (reach["salt"] == copies["salt"]))
        else:
            met = reach.join(labels, reach["src"] == labels["v"])
        offers = met.select(F.col("dst").alias("v"), (F.col("start") + F.col("hop")).alias("start"), "c")
        labels = offers.groupBy("v").agg(F.min(F.struct("start", "c")).alias("best")).select("v", F.col("best.start").alias("start"), F.col("best.c").alias("c"))
    return labels.select("v", "c")


def contract(edges: DataFrame, clusters: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The distinct edges between different clusters. edges: a written table."""
    a = clusters.select(F.col("v").alias("a"), F.col("c").alias("ca"))
    b = clusters.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    n = edges.count()
    both = joined(joined(edges, a, "a", rows=n, hot_rows=hot_rows), b, "b", rows=n, hot_rows=hot_rows)
    return _undirected(both.select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def connected_groups(spark: SparkSession, edges: DataFrame, rounds: int = ROUNDS, hub_degree: int = HUB_DEGREE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(v, group_id) for each vertex of an edge between two different ones; group_id is its group's least vertex.

    edges: (a, b) BIGINT. Nulls, loops and repeated or reversed pairs are dropped; an empty
    table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "groups")
    now = scratch.write(_undirected(edges.select("a", "b")), "edges0")
    level, maps = 0, []
    while not now.isEmpty():
        maps.append(scratch.write(decompose(scratch, now, level, rounds, hub_degree), f"map{level}"))
        now = scratch.write(contract(now, maps[-1], hot_rows), f"edges{level + 1}")
        scratch.drop(f"edges{level}", f"degree{level}")
        scratch.release()
        level += 1
    if not maps:
        return now.select(F.col("a").alias("v"), F.col("b").alias("group_id"))
    # compose from the last level down, so that each join is of the size of its level; a giant group's vertices aren't brought to its centre
    root = maps[-1].select("v", F.col("c").alias("root"))
    for k in range(level - 2, -1, -1):
        up = root.select(F.col("v").alias("c"), F.col("root"))
        root = scratch.write(joined(maps[k], up, "c", "left", hot_rows=hot_rows).select("v", F.coalesce("root", "c").alias("root")), f"root{k}")
    least = root.groupBy("root").agg(F.min("v").alias("group_id"))
    return joined(root, least, "root", hot_rows=hot_rows).select("v", "group_id")


def event_groups(spark: SparkSession, verdicts: DataFrame) -> DataFrame:
    """(event_id, group_id) of all events linked by matches, whether or not they are kept elsewhere."""
    return connected_groups(spark, match_pairs(verdicts)).select(F.col("v").alias("event_id"), "group_id")


def canonical_events(spark: SparkSession, verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, group_id, members, known): each event's group, the group's size and whether the event is still in events."""
    scratch = Scratch(spark, "canonical")
    groups = scratch.write(event_groups(spark, verdicts), "groups")
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("members"))
    known = events.select(F.col("id").alias("event_id"), F.lit(True).alias("is_known")).distinct()
    return joined(groups, sizes, "group_id").join(known, "event_id", "left").select("event_id", "group_id", "members", F.coalesce("is_known", F.lit(False)).alias("known"))
