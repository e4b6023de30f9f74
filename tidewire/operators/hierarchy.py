"""Problem 2: parent-child rows to full hierarchies.

Method: find the connected components, bring each one together, walk it depth first with node
colouring. Components come from pointer doubling over the parent links (each node has at most
one, so a component is a tree, or a cycle with trees on it): log2(depth) rounds. Components are
packed into tasks, sorted, and walked one after the other, so a task's memory is that of its
largest component. A component of more than `co_locate` nodes is never brought together: its
paths come from the same doubling, which carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import Scratch

#: Nodes of a component up to which one task walks it (a few hundred bytes each).
CO_LOCATE = 200_000

PATHS = "node_id bigint, root_id bigint, node_depth int, path_ids array<bigint>, path_labels array<string>, descendants bigint, back_edge boolean"


def _links(nodes: DataFrame) -> DataFrame:
    """(node_id, parent, label): one row per id; a parent that is no id is dropped, so its child is topmost.

    Of rows with the same id that differ, the least (parent, label) counts; rows without id are dropped.
    """
    own = (
        nodes.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("node_id"))
        .agg(F.min(F.struct(F.col("parent_id").alias("parent"), F.col("label").cast("string").alias("label"))).alias("row"))
        .select("node_id", "row.parent", "row.label")
    )
    ids = own.select(F.col("node_id").alias("parent"), F.lit(True).alias("there"))
    known = own.where("parent is not null").join(ids, "parent", "left").select("node_id", F.when(F.col("there"), F.col("parent")).alias("parent"), "label")
    return known.unionByName(own.where("parent is null"))


def _looked_up(state: DataFrame, up: DataFrame, *columns: F.Column) -> DataFrame:
    """state with what `up` has of each jump. Rows without a jump don't take part, else they would all meet in one task."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in up.schema if f.name != "jump"]
    done = state.where("jump is null").select("*", *none)
    return state.where("jump is not null").join(up, "jump", "left").unionByName(done).select(*columns)


def _components(scratch: Scratch, links: DataFrame) -> tuple[DataFrame, int]:
    """(node_id, component, cyclic) and the doublings done.

    jump: the node 2^k links up, null once the top is passed; far: the topmost node seen; least:
    the smallest id among the 2^k nodes from this one on. A round in which no further node
    reaches its top proves that the rest are on a cycle or below one: some open node of each
    tree would have reached it.
    """
    state = scratch.write(
        links.select("node_id", F.col("parent").alias("jump"), F.coalesce("parent", "node_id").alias("far"), F.col("node_id").alias("least")), "jump0"
    )
    k, before = 0, state.where("jump is not null").count()
    total = state.count()
    while before:
        up = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("far").alias("far2"), F.col("least").alias("least2"))
        step = _looked_up(state, up, F.col("node_id"), F.col("jump2").alias("jump"), F.coalesce("far2", "far").alias("far"), F.least("least", "least2").alias("least"))
        k += 1
        state = scratch.write(step, f"jump{k}")
        scratch.drop(f"jump{k - 1}")
        now = state.where("jump is not null").count()
        if now == before:
            while 2**k < 2 * total:  # on to a jump of at least the number of nodes: then it ends on the cycle and has gone all round it
                up = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"))
                both = _looked_up(state, up, F.col("node_id"), F.coalesce("jump2", "jump").alias("jump"), F.col("far"), F.least("least", "least2").alias("least"))
                k += 1
                state = scratch.write(both.withColumn("jump", F.when(F.col("jump").isNotNull(), F.col("jump"))), f"jump{k}")
                scratch.drop(f"jump{k - 1}")
            break
        before = now
    on = state.select(F.col("node_id").alias("jump"), F.col("least").alias("cycle"))
    tagged = _looked_up(state, on, F.col("node_id"), F.coalesce("cycle", "far").alias("component"), F.col("jump").isNotNull().alias("cyclic"))
    return scratch.write(tagged, "components"), k


def _walk(members: list[tuple[int, int | None, str | None]]) -> Iterator[tuple]:
    """Iterative depth-first walk of one component with node colouring: white unseen, grey on the stack, black done."""
    parent = {n: p for n, p, _ in members}
    label = {n: x for n, _, x in members}
    children: dict[int, list[int]] = {}
    tops = []
    for n in sorted(parent):
        if parent[n] is None:
            tops.append(n)
        else:
            children.setdefault(parent[n], []).append(n)
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(parent, white)
    cycle_root = None
    back: set[int] = set()
    if not tops:  # follow parents from any node: the first grey one met again is on the cycle
        n = next(iter(parent))
        trail = []
        while colour[n] == white:
            colour[n] = grey
            trail.append(n)
            n = parent[n]
        ring = trail[trail.index(n) :]
        cycle_root = min(ring)
        for x in trail:
            colour[x] = white
        tops = [cycle_root]
    for top in tops:
        stack: list[tuple[int, int]] = [(top, 0)]
        colour[top] = grey
        ids, labels, below, rows = [top], [label[top]], {top: 0}, {}
        while stack:
            n, at = stack[-1]
            kids = children.get(n, ())
            if at < len(kids):
                stack[-1] = (n, at + 1)
                kid = kids[at]
                if colour[kid] == grey:  # a back edge: kid's parent link closes a circle
                    back.add(kid)
                elif colour[kid] == white:
                    colour[kid] = grey
                    below[kid] = 0
                    ids.append(kid)
                    labels.append(label[kid])
                    stack.append((kid, 0))
            else:
                stack.pop()
                colour[n] = black
                count = below.pop(n)
                yield (n, top, -1 if cycle_root is not None else len(ids) - 1, list(ids), list(labels), count, n in back)
                ids.pop()
                labels.pop()
                if stack:
                    below[stack[-1][0]] += count + 1


def _walk_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("node_id", pa.int64()), ("root_id", pa.int64()), ("node_depth", pa.int32()), ("path_ids", pa.list_(pa.int64())), ("path_labels", pa.list_(pa.string())), ("descendants", pa.int64()), ("back_edge", pa.bool_())]
    )
    out: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def components() -> Iterator[list]:
        held, own = None, []
        for batch in batches:
            for c, n, p, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != held and own:
                    yield own
                    own = []
                held = c
                own.append((n, p, x))
        if own:
            yield own

    for members in components():
        for row in _walk(members):
            out.append(row)
            size += len(row[3]) + 4
            if size > 100_000:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def _doubled_paths(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """PATHS of components too large for one task, by doubling paths; each cycle is cut above its least id, as in the walk."""
    state = scratch.write(
        nodes.select("node_id", "component", "cyclic", F.when(~F.col("cyclic") | (F.col("node_id") != F.col("component")), F.col("parent")).alias("jump"), F.array("node_id").alias("ids"), F.array("label").alias("labels")), "paths0"
    )
    k = 0
    while not state.where("jump is not null").isEmpty():
        up = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("ids").alias("ids2"), F.col("labels").alias("labels2"))
        none_ids, none_labels = F.array().cast("array<bigint>"), F.array().cast("array<string>")
        step = _looked_up(
            state, up, F.col("node_id"), F.col("component"), F.col("cyclic"), F.col("jump2").alias("jump"),
            F.concat(F.coalesce("ids2", none_ids), "ids").alias("ids"), F.concat(F.coalesce("labels2", none_labels), "labels").alias("labels"),
        )
        k += 1
        state = scratch.write(step, f"paths{k}")
        scratch.drop(f"paths{k - 1}")
    below = (
        state.select(F.explode("ids").alias("node_id")).groupBy("node_id").agg((F.count("*") - 1).alias("descendants"))
    )
    return state.join(below, "node_id", "left").select(
        "node_id", F.col("component").alias("root_id"), F.when(F.col("cyclic"), -1).otherwise(F.size("ids") - 1).cast("int").alias("node_depth"),
        F.col("ids").alias("path_ids"), F.col("labels").alias("path_labels"), F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"),
        (F.col("cyclic") & (F.col("node_id") == F.col("component"))).alias("back_edge"),
    )


def hierarchy(spark: SparkSession, nodes: DataFrame, co_locate: int = CO_LOCATE) -> DataFrame:
    """PATHS: for each node its root, depth, path of ids and labels, number of nodes below, and whether its parent link closes a circle.

    nodes: (id, parent_id, label), other columns ignored. Nodes on a cycle or below one have
    depth -1, the least id of the cycle as root, and a path that starts there. Null labels stay
    null in the path. An empty table gives no rows.
    """
    scratch = Scratch(spark, "tree")
    links = scratch.write(_links(nodes), "links")
    components, _ = _components(scratch, links)
    sizes = components.groupBy("component").agg(F.count("*").alias("nodes"))
    all_ = scratch.write(links.join(components, "node_id").join(sizes, "component"), "placed")
    walked = (
        all_.where(F.col("nodes") <= co_locate)
        .select("component", "node_id", "parent", "label")
        .repartition("component")
        .sortWithinPartitions("component", "node_id")
        .mapInArrow(_walk_sorted, PATHS)
    )
    large = all_.where(F.col("nodes") > co_locate)
    return walked if large.isEmpty() else walked.unionByName(_doubled_paths(scratch, large))


def best_above(spark: SparkSession, nodes: DataFrame, value: str) -> DataFrame:
    """A10: (node_id, best): the greatest value of a node and all above it, by pointer doubling; a circle counts once round.

    nodes: (id, parent_id, value), an id once. A round in which no further node reaches its top
    proves that the rest are on circles or below them; then jumps go on until they are as long as
    the number of nodes left.
    """
    scratch = Scratch(spark, "best")
    own = nodes.where("id is not null").select(F.col("id").alias("node_id"), F.col("parent_id").alias("jump"), F.col(value).alias("best"))
    state, k, before, circles = scratch.write(own, "best0"), 0, None, False
    while now := state.where("jump is not null").count():
        circles = circles or now == before
        if circles and 2**k >= now:
            break
        up = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("jump2"), F.col("best").alias("best2"))
        k, before = k + 1, now
        state = scratch.write(_looked_up(state, up, F.col("node_id"), F.col("jump2").alias("jump"), F.greatest("best", "best2").alias("best")), f"best{k}")
        scratch.drop(f"best{k - 1}")
    return state.select("node_id", "best")


def descendants(paths: DataFrame, cyclic: bool = False) -> DataFrame:
    """(ancestor_id, node_id, distance): all nodes below each node, as rows, so that no root's list grows without bound.

    Nodes on a cycle or below one take part if `cyclic`; the cycle is cut above its least id.
    """
    at = F.posexplode(F.slice("path_ids", 1, F.size("path_ids") - 1)).alias("pos", "ancestor_id")
    return paths.where((F.col("node_depth") >= 0) | F.lit(cyclic)).select("node_id", F.size("path_ids").alias("n"), at).select(
        "ancestor_id", "node_id", (F.col("n") - 1 - F.col("pos")).cast("int").alias("distance")
    )
