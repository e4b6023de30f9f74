"""Small fixtures for the core: hierarchy, rolling totals, folds, parsers, console, readers, streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import scores, text
from tidewire.operators import clusters, console, hierarchy, relational, rolling
from tidewire.sources import readers
from tidewire.streaming import streams


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'array<bigint>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    row = spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]
    return row.asDict(True) if hasattr(row, "asDict") else row


# ---- hierarchy ---------------------------------------------------------------------------


def brute(rows):
    parent = {i: p for i, p, _ in rows if i is not None}
    out = {}
    for n in parent:
        seen, x = [], n
        while parent[x] in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            out[n] = (min(seen[seen.index(x) :]), -1)
        else:
            out[n] = (x, len(seen))
    return out


@pytest.mark.parametrize("co_locate", [1_000_000, 3])
def test_hierarchy(spark, co_locate):
    rng = random.Random(3)
    rows = [(i, rng.randrange(max(0, i - 5), i) if i % 9 else None, f"n{i}") for i in range(1, 80)]
    rows += [(100, 101, "a"), (101, 102, None), (102, 100, "c"), (103, 100, "d"), (104, 103, "e"), (110, 110, "self"), (111, 999, "lost"), (None, 1, "no id"), (5, rows[4][1], "n5")]
    df = spark.createDataFrame(rows, "id bigint, parent_id bigint, label string").withColumn("depth", F.lit(9)).withColumn("root_id", F.lit("x"))
    got = hierarchy.hierarchy(spark, df, co_locate).collect()
    assert {r["node_id"]: (r["root_id"], r["node_depth"]) for r in got} == brute(rows)
    assert {r["node_id"] for r in got if r["back_edge"]} == {100, 110}
    below = {r["node_id"]: r["descendants"] for r in got if r["node_depth"] >= 0}
    paths = hierarchy.descendants(hierarchy.hierarchy(spark, df, co_locate)).groupBy("ancestor_id").count().collect()
    assert {k: v for k, v in below.items() if v} == {r["ancestor_id"]: r["count"] for r in paths}
    assert all(r["path_ids"][-1] == r["node_id"] for r in got)


def test_hierarchy_of_nothing(spark):
    assert hierarchy.hierarchy(spark, spark.createDataFrame([], "id bigint, parent_id bigint, label string")).count() == 0


# ---- rolling totals ----------------------------------------------------------------------


def test_rolling_totals(spark):
    t = lambda day, hour=1: dt.datetime(2025, 1, 6) + dt.timedelta(days=day, hours=hour)
    rows = [(1, 7, t(0), 5, None), (2, 7, t(0), 5, None), (3, 7, t(0, 23), -3, 2), (4, 7, t(9), 4, 1), (5, 8, t(2), None, None), (6, None, t(1), 9, 9), (7, 7, None, 9, 9), (8, 7, t(45), 1, 0)]
    df = spark.createDataFrame(rows, "id bigint, item_id bigint, measured_at timestamp, views int, forwards int").withColumn("day", F.lit(0))
    got = {(r["item_id"], r["day"].day, r["day"].month): r for r in rolling.rolling_totals(df).collect()}
    assert len(got) == 46 + 1
    first = got[(7, 6, 1)]
    assert (first["views_7d"], first["forwards_7d"], first["days"]) == (5, 2, 1)
    day9 = got[(7, 15, 1)]
    assert (day9["views_7d"], day9["views_30d"], day9["views_avg_30d"]) == (4, 9, 0.9)
    assert got[(7, 5, 2)]["views_30d"] == 4
    assert rolling.rolling_totals(df.where("false")).count() == 0


# ---- folds -------------------------------------------------------------------------------


def test_independent_sources(spark):
    rows = [(1, 1, "h", 5, None, "A"), (1, 2, "h", 900, None, "B"), (1, 3, "k", 5 ^ 7, None, "C"), (1, 4, "m", (1 << 62) + 12345, " a ", "D"), (1, 5, "z", -1, None, "E"), (2, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "event_id bigint, source_id bigint, content_hash string, simhash bigint, forwarded_from string, source_name string")
    assert {r["event_id"]: r["independent"] for r in clusters.independent_sources(df).collect()} == {1: 2, 2: 1}


def test_greedy_clusters(spark):
    t = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    rows = [("k", 1, t(0), [1.0, 0.0]), ("k", 2, t(1), [0.9, 0.1]), ("k", 3, t(2), [0.0, 1.0]), ("k", 4, t(80), [1.0, 0.0]), ("k", 5, t(81), [0.0, 0.0]), ("k", 6, None, [1.0, 0.0])]
    got = clusters.greedy_clusters(spark.createDataFrame(rows, "k string, id bigint, at timestamp, vector array<double>"), "k").collect()
    assert {r["id"]: r["cluster_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_merged_facts_and_repeats(spark):
    rows = [(1, 1, "five", 5.0, 1, [1.0, 0.0]), (1, 2, "six", 6.0, 2, [1.0, 0.01]), (1, 3, "other", None, 2, [0.0, 1.0])]
    got = clusters.merged_facts(spark.createDataFrame(rows, "event_id bigint, id bigint, text string, value double, source_id bigint, vector array<double>")).collect()
    assert [(r["text"], r["confirmed_by"], r["divergent"]) for r in got] == [("five", 2, True), ("other", 1, False)]
    rows = [("a", 1, 0), ("a", 2, 1), ("a", 3, -1), ("a", 4, -2), ("a", 5, None)]
    r = clusters.repeat_share(spark.createDataFrame(rows, "k string, id bigint, simhash bigint"), "k").first()
    assert (r["n"], r["repeats"]) == (4, 2)


def test_hamming_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(20)]
    values = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base for _ in range(3)] + base[:3]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, h bigint")
    got = {(r["a"], r["b"], r["distance"]) for r in relational.hamming_pairs(df, "id", "h", 6).collect()}
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 6}
    assert got == want


def test_nearest_before(spark):
    left = spark.createDataFrame([(1, 10, "x"), (1, 5, "y"), (2, 7, "z")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (3, 1, "c")], "k int, u int, v string")
    got = {r["name"]: r["last_v"] for r in relational.nearest_before(left, right, ["k"], "t", "u", "v").collect()}
    assert got == {"x": "b", "y": None, "z": None}


# ---- text, scores, parsers ---------------------------------------------------------------


def test_text(spark):
    assert one(spark, text.normalize_text("t"), t="  Привіт   Світ \n") == "привіт світ"
    assert text._simhash(None, "") == 0 and (text._simhash("a", "b c d e f g h") ^ text._simhash("a", "b c d e f g x")).bit_count() < 40
    assert one(spark, text.any_match("t", ["дрон"], ignorecase=True), t="ДРОН летить") is True
    assert text.split_text("a" * 10, 4) == ["aaaa", "aaaa", "aa"] and text.split_text("abc def ghi", 8) == ["abc def", "ghi"] and text.split_text("", 5) == []
    assert one(spark, text.strip_html("t"), t="<p>a &amp; b</p> ") == "a & b"
    assert len(text.phash_pixels(list(range(1024)))) == 16
    with pytest.raises(Exception, match="unknown level"):
        spark.range(1).select(scores.gate_decision(F.lit("odd"), F.lit(1), F.lit(True), F.lit(True), F.lit(True), F.lit(False)).alias("x")).collect()


# ---- console, readers, streams -----------------------------------------------------------


def test_console(spark):
    spark.range(80).createOrReplaceTempView("numbers")
    ok = ["SELECT 1", "with x as (select 1) select * from x", "select ';' as a"]
    bad = [None, "", "select 1; select 2", "drop table numbers", "insert into numbers select 1", "select * from parquet.`/tmp/x`", "select reflect('a', 'b')", "selec"]
    assert all(console.is_readonly(spark, q) for q in ok) and not any(console.is_readonly(spark, q) for q in bad)
    rows, more = console.run_readonly(spark, "select id from numbers order by id", seconds=60)
    assert len(rows) == 50 and more and console.as_text(rows[:2]) == "id\n0\n1"
    assert console.bounded_int("99", 5, 1, 30) == 30 and console.bounded_int("x", 5, 1, 30) == 5


FEED = b"""<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><language>uk</language>
<item><guid>g1</guid><link>http://a</link><title>T &amp; x</title><description>D</description><pubDate>Mon, 06 Jan 2025 10:00:00 +0200</pubDate>
<enclosure url="http://i/1.jpg" type="image/jpeg" length="12x"/><media:content url="http://i/1.jpg"/><media:content url="http://i/placeholder.png"/></item>
<item><title>no id</title></item></channel></rss>"""


def test_readers(spark):
    raw = spark.createDataFrame([(1, bytearray(FEED)), (2, bytearray(b"no feed")), (3, None)], "source_id int, content binary")
    rows = readers.feeds(raw).withColumn("at", readers.published_at("published")).collect()
    assert len(rows) == 1 and rows[0]["external_id"] == "g1" and rows[0]["title"] == "T & x" and len(rows[0]["media"]) == 1 and rows[0]["at"] == dt.datetime(2025, 1, 6, 8)
    page = """<meta content='http://t' name="twitter:image"><META content="http://o" property="og:image" />"""
    assert one(spark, readers.og_image("p"), p=page) == "http://o" and one(spark, readers.og_image("p"), p="<p>") is None
    good = {"kind": "rss", "handle_or_url": "http://a", "origin": "ua", "tier": "media"}
    assert readers.source_rows(spark, [good]).first()["poll_interval"] == 300
    for wrong in ({**good, "kind": "fax"}, {**good, "poll_interval": True}):
        with pytest.raises(ValueError):
            readers.source_rows(spark, [wrong])


def test_streams_equal_batches(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    posts = spark.createDataFrame([(1, 9, t(0), None), (2, 9, t(1), "cap"), (3, 9, t(3), "late"), (4, None, t(0), "x")], "id bigint, grouped_id bigint, arrived_at timestamp, text string")
    got = sorted((r["id"], r["parts"], r["caption"]) for r in streams.albums(posts).collect())
    assert got == [(1, 2, "cap"), (3, 1, "late")]
    arrivals = spark.createDataFrame([(1, "a", 1, "h"), (1, "a", 2, "h"), (1, "a", 3, "k"), (1, "b", 4, "h")], "source_id bigint, external_id string, id bigint, content_hash string")
    arrivals.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals.schema).parquet(str(tmp_path / "in"))
    q = streams.version_stream(stream).writeStream.format("memory").queryName("versions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = relational.versions(arrivals, ["source_id", "external_id"], ["id"], "content_hash").select("id", "version").collect()
    assert sorted((r["id"], r["version"]) for r in spark.table("versions").collect()) == sorted(map(tuple, batch)) == [(1, 1), (3, 2), (4, 1)]


def test_the_library_does_not_import_llm():
    from pathlib import Path

    import tidewire

    here = Path(tidewire.__file__).parent
    assert not [p for p in here.rglob("*.py") if "llm" not in p.parts and "tidewire.llm" in p.read_text()]
