"""Small fixtures: nulls, empty and very long texts, ties, repeated rows, empty tables, further columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import components, history, lines, mixing, neardup, packing, stuffing, vectors
from tidewire.session import Scratch


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


def test_groups_of_chains_stars_and_dirt(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(1000, 1120)] + [(5000, 5001 + i) for i in range(150)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    pairs += [(7, None), (None, 7), (9, 9), (1001, 1000), (1000, 1001)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("v", F.lit("x")).withColumn("c", F.lit(1))
    got = {tuple(r) for r in components.connected_groups(spark, df, hub_degree=20).collect()}  # the star is a hub and is salted
    assert got == groups(pairs)


def test_groups_of_nothing(spark):
    assert components.connected_groups(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def records(rows):
    return [(i, t, x) for i, t, x in rows]


TEXT = " ".join(f"word{i} number{i * 7} goes" for i in range(60))


def test_neardup_edges(spark):
    rows = [
        (1, None, TEXT), (2, None, TEXT), (2, None, TEXT), (3, "title", TEXT + " and a few more words"), (4, None, None), (5, "", ""), (6, None, "one two"), (7, None, "one two"),
        (8, None, "a b c"), (9, "a", "b c"), (10, None, "x " * 40_000), (11, None, "x " * 50_000), (12, None, " ".join(f"other{i}" for i in range(100))), (None, "t", TEXT),
    ]
    df = spark.createDataFrame(rows, "id bigint, title string, text string").withColumn("class", F.lit(3)).withColumn("x", F.lit(3))
    got = {(r["item_a"], r["item_b"]) for r in neardup.similar_pairs(spark, df).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (8, 9), (10, 11)}
    classes = {r["item_id"]: (r["class_id"], r["group_id"]) for r in neardup.similar_groups(spark, df).collect()}
    assert classes[2] == (1, 1) and classes[3] == (3, 1) and classes[6] == (6, 6) and len(classes) == 12
    assert neardup.similar_pairs(spark, df.where("false")).count() == 0


def test_neardup_of_records_that_are_half_template(spark):
    """A similarity of 0.50, of which common shingles are two thirds: what is signed without them has 0.25."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, rows = fresh(47), []
    for i in range(60):
        shared = template + fresh(22)
        rows += [(2 * i, None, " ".join(shared + fresh(33))), (2 * i + 1, None, " ".join(shared + fresh(33)))]
    df = spark.createDataFrame(rows, "id bigint, title string, text string")
    got = {(r["item_a"], r["item_b"]) for r in neardup.similar_pairs(spark, df).collect()}
    want = {(2 * i, 2 * i + 1) for i in range(60)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_history_edges(spark):
    old = spark.createDataFrame([(1, None, TEXT), (1, None, TEXT), (2, None, None), (3, "a b", "c d")], "id bigint, title string, text string")
    new = spark.createDataFrame([(10, 1, None, TEXT + " more"), (11, 2, None, TEXT), (12, 2, "a", "b c d"), (13, 1, None, ""), (14, None, None, TEXT), (11, 2, None, TEXT)], "id bigint, batch_id int, title string, text string")
    got = {(r["old_id"], r["new_id"]) for r in history.earlier_copies(spark, old, new).collect()}
    assert got == {(1, 10), (1, 11), (10, 11), (3, 12)}
    assert history.earlier_copies(spark, old.where("false"), new).count() == 1
    assert history.earlier_copies(spark, old, new.where("false")).count() == 0


def test_history_finds_every_pair_of_the_threshold(spark):
    """Sizes at which the old record had other kinds of fingerprints than the new one, and texts that share no long run."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    three = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    old, new = {}, {}
    for i in range(120):
        words = fresh((50, 30, 90)[i % 3])
        other = words[: len(words) - 5 * (i % 3 == 0)]
        if i % 3 == 2:  # the same pieces of seven words in another order
            pieces = [words[k : k + 7] for k in range(0, len(words), 7)]
            rng.shuffle(pieces)
            other = [x for piece in pieces for x in piece]
        else:
            for k in rng.sample(range(len(other)), 1 + i % 2):
                other[k] = "changed"
        old[i], new[1000 + i] = words, other
    old[500], new[1500] = ["x"] * 4000, ["x"] * 12  # one class, of very different length
    want = {(a, b) for a, x in old.items() for b, y in new.items() if three(x) & three(y) and 2 * len(three(x) & three(y)) >= len(three(x) | three(y))}
    history_ = spark.createDataFrame([(i, None, " ".join(t)) for i, t in old.items()], "id bigint, title string, text string")
    incoming = spark.createDataFrame([(i, 1, None, " ".join(t)) for i, t in new.items()], "id bigint, batch_id int, title string, text string")
    assert len(want) > 90
    assert {(r["old_id"], r["new_id"]) for r in history.earlier_copies(spark, history_, incoming).collect()} == want


def test_lines(spark):
    footer = "Subscribe to our channel now"
    rows = [(i, 1, f"news item {i} about thing {i}\n {footer.upper()} \r\nlast {i}") for i in range(20)] + [(5, 1, f"news item 5 about thing 5\n {footer.upper()} \r\nlast 5")]
    rows += [(100 + i, 2, f"unique {i}") for i in range(5)] + [(200, None, footer), (201, 1, None), (202, 1, " \n ")]
    df = spark.createDataFrame(rows, "id bigint, source_id int, text string").withColumn("line", F.lit(1))
    got = {(r["source_id"], r["line"], r["documents"]) for r in lines.repeated_lines(spark, df).collect()}
    assert got == {(1, footer.lower(), 20)}
    clean = {r["id"]: r["text"] for r in lines.cleaned(spark, df).collect()}
    assert clean[3] == "news item 3 about thing 3\nlast 3" and clean[201] is None and clean[200] == footer and len(clean) == 28
    assert lines.repeated_lines(spark, df.where("false")).count() == 0


def test_chunks_depend_on_content_only():
    line = "the same wording stands here and there, long enough to be cut more than once by content"
    _, a, la = lines.chunks([line, "x"])
    _, b, lb = lines.chunks(["something before", line])
    assert list(a[la == 0]) == list(b[lb == 1])


@pytest.mark.parametrize("room", [0, 1, 7, 64])
def test_fill_is_the_best_subset_sum(room):
    rng = random.Random(room)
    for _ in range(20):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        used = packing.fill(counts, room)
        best = {0}
        for k, n in counts.items():
            for _ in range(n):
                best |= {s + k for s in best if s + k <= room}
        assert sum(k * n for k, n in used.items()) == max(best) and all(n <= counts[k] for k, n in used.items())


def test_packing_keeps_every_token(spark):
    docs = spark.createDataFrame([(i, "слово and words " * (i % 37)) for i in range(200)] + [(999, None), (0, "")], "doc_id bigint, text string")
    windows = spark.createDataFrame([("w", 50), ("bad", 0), (None, 5)], "window_name string, capacity_tokens int")
    placed = packing.packed(spark, docs, windows).cache()
    per = placed.groupBy("container").agg(F.sum("tokens").alias("t")).collect()
    assert max(r["t"] for r in per) <= 50 and [r["container"] for r in sorted(per, key=lambda r: r["container"])] == list(range(len(per)))
    assert placed.select("doc_id", "piece").distinct().count() == placed.count()
    total = placed.agg(F.sum("tokens")).first()[0]
    assert total == packing.tokenizer.counted(docs.where("text is not null"), "text").agg(F.sum("tokens")).first()[0] and len(per) <= total / 50 * 1.1 + 1
    assert packing.packed(spark, docs.where("false"), windows).count() == 0


def test_mixing_reaches_shares(spark):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else "b", "alpha beta " * rng.randrange(1, 40)) for i in range(600)] + [(1000, None, "alpha beta"), (1001, "c", "gamma"), (1002, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("none", None, 2), ("missing", 0.2, 1)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mixed_shares(spark, docs, targets).collect()}
    assert abs(shares["a"]["actual_share"] - 0.5) < 0.02 and shares["b"]["most_uses"] <= 2 and shares["missing"]["mixed_tokens"] == 0
    assert mixing.mixed(spark, docs.where("false"), targets).count() == 0


def test_vectors_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.05).tolist()) for i in range(15)] + [(100 + i, rng.normal(size=64).tolist()) for i in range(50)]
    rows += [(200, None), (201, [0.0] * 64), (202, [1.0] * 3), (203, [None] * 64), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "id bigint, centroid array<float>").withColumn("q", F.lit(1))
    got = {tuple(r) for r in vectors.similar_stories(spark, df).collect()}
    assert all(a < 15 and b < 15 for a, b in got) and len(got) >= 0.9 * 75
    assert vectors.similar_stories(spark, df.where("false")).count() == 0


def test_stuffing_edges(spark):
    rng = random.Random(4)
    nouns = [a + b for a in "bridge river council market garden winter school harbour train letter".split() for b in ("", "s", "ers", "ing", "ment")]
    verbs = [a + b for a in "open clos repair visit pass clear report answer".split() for b in ("ed", "es", "ing")]

    def prose(n):
        return " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} on the {rng.choice(nouns)}, and a {rng.choice(nouns)} was {rng.choice(verbs)} by the {rng.choice(nouns)}." for _ in range(n))

    spam = "buy cheap phones online, cheap phones, phones online, buy online cheap, " * 12
    rows = [(i, prose(2 + i % 4)) for i in range(300)] + [(1000, spam), (1001, "#sale #phones #cheap " * 30), (1002, None), (1003, "  "), (1004, prose(1500))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("share", F.lit(1))
    got = {r["doc_id"] for r in stuffing.stuffed_documents(spark, df).collect()}
    assert got == {1000, 1001}
    assert stuffing.stuffed_documents(spark, df.where("false")).count() == 0


def test_broken_encoding_is_read_again():
    text = "Рада повідомила, що рух обмежено до неділі."
    broken = text.encode().decode("cp1252", "replace")
    assert sum(a == b for a, b in zip(stuffing.repaired(broken), text)) > 0.8 * len(text)


def test_repeated_runs_within_lines_are_cut(spark):
    """A notice in the same line as a post's own words: all of it goes, and nothing else."""
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    notice = "This message was brought to you by the desk of the Harbour Courier; subscribe for more news, and do not forward it without the written consent of the publisher."
    own = {i: (fresh(20), fresh(5) if i % 2 else "") for i in range(40)}
    rows = [(i, 1, f"{a} {notice} {b}".rstrip()) for i, (a, b) in own.items()] + [(100 + i, 2, fresh(30)) for i in range(40)]
    rows += [(200, None, notice), (201, 1, None), (202, 1, ""), (203, 1, "short\n" + notice), (204, 2, f"{fresh(3)} {notice}")]
    df = spark.createDataFrame(rows, "id bigint, source_id int, text string").withColumn("line", F.lit("x")).withColumn("key", F.lit(1))
    got = {r["id"]: r["text"] for r in lines.cleaned(spark, df.unionByName(df.where("id < 3"))).collect()}
    given = {i: t for i, _, t in rows}
    want = {i: f"{own[i][0]} {own[i][1]}".rstrip() if i in own else given[i] for i in given} | {203: "short"}
    assert got == want
    assert lines.cleaned(spark, df.where("false")).count() == 0


EDITS = (9, 10, 11, 12, 14)


def evenly_edited(seed):
    """Pairs of records of which the second has every n-th word replaced: no long run is left."""
    rng = random.Random(seed)
    old, new = {}, {}
    for k, gap in enumerate(EDITS):
        for i in range(30):
            words = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(90, 161))]
            old[k * 30 + i] = words
            new[1000 + k * 30 + i] = [f"c{rng.randrange(10**9)}" if p % gap == gap // 2 else w for p, w in enumerate(words)]
    return old, new


def test_history_finds_evenly_edited_records_and_opens_again(spark, tmp_path):
    three = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    old, new = evenly_edited(3)
    want = {(i, 1000 + i) for i in old if 2 * len(three(old[i]) & three(new[1000 + i])) >= len(three(old[i]) | three(new[1000 + i]))}
    frame = lambda texts: spark.createDataFrame([(i, None, " ".join(t)) for i, t in texts.items()], "id bigint, title string, text string")
    store = history.FingerprintStore.create(spark, str(tmp_path / "store"), frame({i: t for i, t in old.items() if i % 2}))
    store.accept(store.stage(frame({i: t for i, t in old.items() if i % 2 == 0})))
    store.stage(frame(new))  # staged, never accepted: as after a crash
    again = history.FingerprintStore.open(spark, str(tmp_path / "store"))
    assert again.batches == 2 and again.parts == store.parts
    match = lambda s: {(r["old_id"], r["id"]) for r in s.match(s.stage(frame(new))).collect()}
    got = match(again)
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)
    again.split(20)
    assert match(history.FingerprintStore.open(spark, str(tmp_path / "store"))) == got


def test_keys_of_many_classes_are_joined_in_blocks(spark):
    rows = [(7, c) for c in range(90)] + [(8, c) for c in range(3)] + [(9, 1), (7, 5)]
    keys = spark.createDataFrame(rows, "key bigint, class bigint")
    got = [tuple(r) for r in neardup.met_pairs(Scratch(spark, "keys"), keys, "shared", hot=10).collect()]
    assert sorted(got) == sorted([(x, y) for y in range(90) for x in range(y)] + [(0, 1), (0, 2), (1, 2)])


def brute_nearest(rows, asked, k=10):
    ids, m = [i for i, _ in rows], np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for q in asked:
        cos = np.round(m @ m[ids.index(q)], 9)
        out |= {(q, c) for _, c in sorted((-x, c) for x, c in zip(cos, ids) if c != q)[:k]}
    return out


def test_copies_of_vectors_are_one_and_large_buckets_are_split(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    near = [(base + rng.normal(size=64) * 0.1).tolist() for _ in range(60)]
    rows = [(i, near[0]) for i in range(0, 120, 2)] + [(1000 + i, v) for i, v in enumerate(near[1:])] + [(2000 + i, (-base + rng.normal(size=64) * 0.1).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, centroid array<double>")
    want = brute_nearest(rows, [i for i, _ in rows])
    got = [(r["q"], r["c"]) for r in vectors.nearest(spark, df, "id", "centroid", hot=25, code_bits=60).collect()]
    assert len(got) == len(set(got)) and len(set(got) & want) >= 0.95 * len(want)
    copies = {(q, c) for q, c in want if q < 200}
    assert copies <= set(got)
    asked = [i for i, _ in rows if i % 10 == 0]
    queries_ = vectors.vectors(df.where("id % 10 = 0"), "id", "centroid")
    got = [(r["q"], r["c"]) for r in vectors.nearest(spark, df, "id", "centroid", queries=queries_, code_bits=60).collect()]
    want = brute_nearest(rows, asked)
    assert len(got) == len(set(got)) and len(set(got) & want) >= 0.95 * len(want) and {x for x in want if x[0] < 200} <= set(got)


def test_nearest_vectors_are_all_found_however_they_are_grouped(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(2600, 64))
    v[2000:] = v[:600] + rng.normal(size=(600, 64)) * rng.uniform(0.1, 0.6, size=(600, 1))
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, centroid array<float>")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    top = np.argsort(-cos, axis=1)[:, :10]
    want = {(i, int(j), n + 1) for i in range(len(v)) for n, j in enumerate(top[i])}
    for hot in (300, 10_000):
        rows = vectors.nearest(spark, df, "id", "centroid", hot=hot).collect()
        assert {(r["q"], r["c"], r["rank"]) for r in rows} == want and len(rows) == len(want)
        rows = vectors.nearest(spark, df, "id", "centroid", hot=hot, floor=0.9).collect()
        assert {(r["q"], r["c"]) for r in rows} == {(i, j) for i, j, _ in want if cos[i, j] >= 0.9} and len(rows) > 500
    asked = vectors.vectors(df.where("id % 7 = 0"), "id", "centroid")
    for hot in (300, 10_000):
        rows = vectors.nearest(spark, df, "id", "centroid", hot=hot, queries=asked).collect()
        assert {(r["q"], r["c"], r["rank"]) for r in rows} == {w for w in want if w[0] % 7 == 0}


def test_groups_with_joins_of_hot_keys(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5001)]
    got = {tuple(r) for r in components.connected_groups(spark, spark.createDataFrame(pairs, "a bigint, b bigint"), hub_degree=20, hot_rows=30).collect()}
    assert got == groups(pairs)


def test_packing_does_not_depend_on_the_blocks(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "word " * rng.choice((3, 3, 3, 7, 20))) for i in range(200)], "doc_id bigint, text string")
    windows = spark.createDataFrame([("w", 40)], "window_name string, capacity_tokens int")
    one, many = (packing.packed(spark, docs, windows, blocks=b).collect() for b in (1, 7))
    for placed in (one, many):
        room = {}
        for r in placed:
            room[r["container"]] = room.get(r["container"], 0) + r["tokens"]
        assert max(room.values()) <= 40 and len({(r["doc_id"], r["piece"]) for r in placed}) == len(placed) == 200
    assert len({r["container"] for r in one}) == len({r["container"] for r in many})
