"""The registered queries of the subpackage against SQL, or against brute force where SQL can't say it."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

from tidewire.llm import oracles, queries  # noqa: E402

TOKEN = re.compile(r"[0-9a-zA-Zа-яА-ЯіІїЇєЄґҐ']+")


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(name, spark, sf, duck):
    assert compare(queries.QUERIES[name](spark, sf), duck, oracles.ORACLES[name]) == ""


def shingles(title, text):
    t = TOKEN.findall(f"{title or ''} {text or ''}".lower())
    return {tuple(t[i : i + 3]) for i in range(len(t) - 2)}


def similar(a, b):
    return bool(a and b) and 2 * len(a & b) >= len(a | b)


def test_p4_finds_all_similar_pairs(spark, sf, duck):
    rows = {i: shingles(a, b) for i, a, b in duck.sql("SELECT DISTINCT id, title, text FROM news_items").fetchall()}
    ids = sorted(rows)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if similar(rows[a], rows[b])}
    assert {tuple(r) for r in queries.p4_found(spark, sf).collect()} == want


def test_p3_finds_all_earlier_copies(spark, sf, duck):
    old = [(i, 0, shingles(a, b)) for i, a, b in duck.sql("SELECT DISTINCT id, title, text FROM news_items").fetchall()]
    new = [(i, n, shingles(a, b)) for i, n, a, b in duck.sql("SELECT DISTINCT id, batch_id, title, text FROM raw_items").fetchall()]
    want = {(o, i) for i, n, s in new for o, m, t in old + new if m < n and o < i and similar(s, t)}
    assert {tuple(r) for r in queries.p3_found(spark, sf).collect()} == want


def test_p6_recall(spark, sf, duck):
    import numpy as np

    rows = [(i, v) for i, v in duck.sql("SELECT id, any_value(centroid) FROM stories WHERE len(centroid) = 64 GROUP BY id").fetchall() if any(v)]
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = v @ v.T
    np.fill_diagonal(cos, -2)
    want = set()
    for i, near in enumerate(np.argsort(-cos, axis=1)[:, :10]):
        want |= {tuple(sorted((ids[i], ids[j]))) for j in near if cos[i, j] >= 0.9}
    got = {tuple(r) for r in queries.p6_found(spark, sf).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_p8_and_p9_reports(spark, sf):
    fill = queries.p8_fill(spark, sf).collect()
    assert len(fill) == 3 and len({r["tokens"] for r in fill}) == 1
    assert all(0.9 < r["fill"] <= 1 for r in fill if r["containers"] > 10)
    shares = queries.p9_shares(spark, sf).collect()
    assert all(r["most_uses"] <= r["max_repeats"] for r in shares)
