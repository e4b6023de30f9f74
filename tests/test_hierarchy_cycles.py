"""Problem 2: paths and descendants of nodes on cycles and below them, walked and doubled."""

import pytest
from oracle import connect

from tidewire.operators import hierarchy
from tidewire.plans import queries


def brute(parent):
    """node -> path of ids from its top, or from the least id of its cycle."""
    out = {}
    for n in parent:
        trail, x = [n], parent[n]
        while x in parent and x not in trail:
            trail.append(x)
            x = parent[x]
        if x in trail:
            least = min(trail[trail.index(x) :])
            trail = trail[: trail.index(least) + 1]
        out[n] = trail[::-1]
    return out


ROWS = [(100, 101), (101, 102), (102, 100), (103, 101), (104, 103), (105, 104), (110, 110), (111, 110), (203, 202), (202, 201), (201, 200), (200, 203), (1, None), (2, 1), (3, 2), (4, 999)]


@pytest.mark.parametrize("co_locate", [1_000_000, 1])
def test_paths_and_counts_of_cyclic_nodes(spark, co_locate):
    df = spark.createDataFrame([(i, p, f"n{i}") for i, p in ROWS], "id bigint, parent_id bigint, label string")
    paths = hierarchy.hierarchy(spark, df, co_locate)
    got = {r["node_id"]: r for r in paths.collect()}
    want = brute(dict(ROWS))
    assert {n: r["path_ids"] for n, r in got.items()} == want
    assert all(r["path_labels"] == [f"n{i}" for i in r["path_ids"]] and r["root_id"] == r["path_ids"][0] for r in got.values())
    below = {(a, n, len(p) - 1 - k) for n, p in want.items() for k, a in enumerate(p[:-1])}
    assert {tuple(r) for r in hierarchy.descendants(paths, cyclic=True).collect()} == below
    assert {n: r["descendants"] for n, r in got.items()} == {n: sum(a == n for a, _, _ in below) for n in want}


def test_queries_give_every_node(spark, sf):
    parent = dict(connect(sf).sql("SELECT id, min(parent_id) FROM taxonomy_nodes WHERE id IS NOT NULL GROUP BY id").fetchall())
    want = brute(parent)
    got = queries.QUERIES["p2_all_paths"](spark, sf).collect()
    assert sorted(r["node_id"] for r in got) == sorted(want) and all(r["root_id"] == want[r["node_id"]][0] for r in got)
    below = {(a, n, len(p) - 1 - k) for n, p in want.items() for k, a in enumerate(p[:-1])}
    assert {tuple(r) for r in queries.QUERIES["p2_all_descendants"](spark, sf).collect()} == below
