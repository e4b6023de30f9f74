"""Operators added to the core: brute force on small fixtures, nulls, ties, empty tables."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import clusters, console, hierarchy, relational
from tidewire.plans import queries
from tidewire.session import get_json, joined, put_json


def test_exact_median(spark):
    rng = random.Random(1)
    rows = [("a", float(rng.randrange(50))) for _ in range(501)] + [("b", rng.random()) for _ in range(400)] + [("c", 3.0)] + [("d", 1.0), ("d", 2.0)] + [("e", None)] + [(None, 4.0)] * 3
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(1))
    got = {r["g"]: r["median"] for r in relational.exact_median(df, "g", "v", parts=16).collect()}
    want = {g: statistics.median(v for k, v in rows if k == g) for g in "abcd"}
    assert {k: v for k, v in got.items() if k} == pytest.approx(want)
    assert relational.exact_median(df.where("false"), "g", "v").count() == 0


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(80)] + [(100, None), (101, [1.0, 2.0]), (102, [0.0] * 8)]
    rows += [(200 + i, rows[0][1]) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").withColumn("score", F.lit("x"))
    known = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 8]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    want = set()
    for q, v in known:
        if q % 20 == 0:
            best = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in known if i != q)[:5]
            want |= {(q, i) for _, i in best}
    got = relational.nearest_vectors(df.where("id % 20 = 0 and id <> 100"), df, "id", "v", 5).collect()
    assert {(r["query_id"], r["id"]) for r in got if r["query_id"] != 200} == {w for w in want if w[0] != 200}
    assert relational.nearest_vectors(df.where("false"), df, "id", "v", 5).count() == 0
    assert relational.nearest_vectors(df.where("id = 0"), df.where("false"), "id", "v", 5).count() == 0


def test_hamming_pairs_within_a_group(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, rng.getrandbits(12) - 2048) for i in range(90)] + [(500, None, 1), (501, 1, None), (None, 1, 1)]
    df = spark.createDataFrame(rows, "id bigint, g int, h bigint")
    for most in (0, 1, 3, 6):
        got = {tuple(r) for r in relational.hamming_pairs(df, "id", "h", most, "g").collect()}
        d = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
        want = {(i, j, d(x, y)) for i, g, x in rows[:90] for j, k, y in rows[:90] if i < j and g == k and d(x, y) <= most}
        assert got == want


def test_best_above_with_circles(spark):
    rows = [(1, None, 0.1), (2, 1, 0.5), (3, 2, 0.2), (4, 99, 0.3), (10, 12, 0.0), (11, 10, 0.9), (12, 11, 0.0), (13, 12, 0.1), (20, 20, 0.4)] + [(100 + i, 99 + i if i else None, 1.0 if i == 0 else 0.0) for i in range(70)]
    got = {r["node_id"]: r["best"] for r in hierarchy.best_above(spark, spark.createDataFrame(rows, "id bigint, parent_id bigint, heat double"), "heat").collect()}
    assert got == {1: 0.1, 2: 0.5, 3: 0.5, 4: 0.3, 10: 0.9, 11: 0.9, 12: 0.9, 13: 0.9, 20: 0.4} | {100 + i: 1.0 for i in range(70)}
    assert hierarchy.best_above(spark, spark.createDataFrame([], "id bigint, parent_id bigint, heat double"), "heat").count() == 0


def test_joined_takes_hot_keys_apart(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1), (None, 1)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, y string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, joined(left, right, "k", how, hot_rows=10).collect())) == want


def test_settings(spark, tmp_path):
    put_json(spark, str(tmp_path / "a.json"), {"x": 1})
    assert get_json(spark, str(tmp_path / "a.json")) == {"x": 1} and get_json(spark, str(tmp_path / "b.json")) is None


def test_files_cannot_be_read_in_any_quotes(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    for q in ("select * from `parquet`.`/x`", "select (select max(a) from `json`.`/x`) from numbers", "with a as (select * from CSV.`/x`) select * from a", "select 1 from numbers where exists (select 1 from `orc` . `/x`)"):
        assert not console.is_readonly(spark, q)
    assert console.is_readonly(spark, "select n.id from default.numbers n") and console.is_readonly(spark, "select 'parquet.`x`' as a from numbers")


def test_pauses_split_the_fold_without_changing_it(spark):
    import datetime as dt

    rng = np.random.default_rng(5)
    rows = [("k", i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=float(h)), rng.normal(size=3).tolist()) for i, h in enumerate(np.cumsum(rng.exponential(20, 80)))]
    df = spark.createDataFrame(rows, "k string, id bigint, at timestamp, vector array<double>")
    got = {r["id"]: r["cluster_id"] for r in clusters.greedy_clusters(df, "k", threshold=0.6).collect()}
    held = []
    for _, i, at, v in rows:
        v = np.array(v)
        cos = [(float(c["v"] @ v / np.linalg.norm(c["v"]) / np.linalg.norm(v)), -n) for n, c in enumerate(held) if (at - c["at"]).total_seconds() <= 48 * 3600]
        best = max(cos, default=(0, 0))
        if cos and best[0] >= 0.6:
            c = held[-best[1]]
            c["v"], c["n"], c["at"] = (c["v"] * c["n"] + v) / (c["n"] + 1), c["n"] + 1, at
        else:
            held.append(c := {"v": v, "n": 1, "at": at, "id": i})
        assert got[i] == c["id"]


def test_a_long_fold_ends_and_its_blocks_dont_show(spark):
    import datetime as dt
    import time

    rng = np.random.default_rng(6)
    v = rng.normal(size=(6000, 64))
    v[1::3] = v[::3] + rng.normal(size=(2000, 64)) * 0.5
    rows = [("k", i, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=10 * i), x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, id bigint, at timestamp, vector array<double>")
    began = time.time()
    got = {r["id"]: r["cluster_id"] for r in clusters.greedy_clusters(df, "k").collect()}
    assert time.time() - began < 30  # with all closed clusters looked through for each row: too slow
    alike = sum(got[i] == i - 1 for i in range(1, 6000, 3))
    assert len(got) == 6000 and alike > 1900 and len(set(got.values())) == 6000 - alike
    assert {r["id"]: r["cluster_id"] for r in clusters.greedy_clusters(df, "k", block=7).collect()} == got


def test_a_vector_with_nulls_takes_no_others_from_their_clusters(spark):
    import datetime as dt

    rows = [(i, dt.datetime(2025, 1, 1, i), x) for i, x in enumerate([[1.0, None], [1.0, 0.0], [1.0, 0.1], [0.0, 0.0], [1.0], [2.0, 0.0], [3.0]])]
    df = spark.createDataFrame(rows, "id bigint, at timestamp, vector array<double>").withColumn("k", F.lit("k"))
    assert {r["id"]: r["cluster_id"] for r in clusters.greedy_clusters(df, "k").collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 4}


def test_pieces_of_whole_documents(spark, sf):
    import duckdb

    want = {i: [len(p) for p in text.split_text(t)] for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    got: dict = {}
    for r in queries.QUERIES["x30_split_text"](spark, sf).orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append(r["n"])
    assert got == {i: p for i, p in want.items() if p}
