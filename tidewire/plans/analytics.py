"""Queries of joins, aggregates, ranks, states and reports, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import scores, text
from tidewire.operators import relational as R
from tidewire.plans import adapters as A
from tidewire.plans.reference import AS_OF, BOTH, EVENTS, ITEMS, JOURNAL, KINDS, METRICS, NORM, SUBS, TIERS, _case, _map, query
from tidewire.session import table

_LATEST = f"(SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY item_id ORDER BY measured_at DESC, id DESC) AS rn FROM {METRICS} m) WHERE rn = 1)"
_RATED = f"""(SELECT m.item_id, m.rubric, s.name, s.tier, (coalesce(m.likes, 0) + 2 * coalesce(m.forwards, 0)) / s.subscribers AS rate FROM {_LATEST} m JOIN {SUBS} s ON s.source_id = m.source_id WHERE s.subscribers > 0)"""


def _latest_rated(spark, d):
    m = R.latest(A.metrics(spark, d), ["item_id"], F.desc("measured_at"), F.desc("id"))
    s = A.source_metrics(spark, d).where("subscribers > 0")
    return m.join(s, "source_id").select("item_id", "rubric", "name", "tier", scores.engagement_rate("reactions", "forwards", "subscribers").alias("rate"))


# ---- aggregates --------------------------------------------------------------------------


@query(f"SELECT status, count(*) AS n FROM {EVENTS} GROUP BY status")
def a01_status_counts(spark, d):
    return A.news_events(spark, d, "status").groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT rubric, median(rate * {_case('tier', TIERS)}) AS v FROM {_RATED} GROUP BY rubric),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM m) SELECT rubric, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS demand FROM m, b""")
def a02_rubric_demand(spark, d):
    weighted = _latest_rated(spark, d).withColumn("weighted", F.col("rate") * _map(F.col("tier"), TIERS))
    medians = R.exact_median(weighted, "rubric", "weighted").withColumnRenamed("median", "v")
    # one row per rubric: the whole-table window runs over a vocabulary
    all_ = Window.partitionBy(F.lit(1))
    return medians.select("rubric", F.round(scores.min_max("v", F.min("v").over(all_), F.max("v").over(all_)), 6).alias("demand"))


@query(f"SELECT item_id, round(rate, 6) AS rate FROM {_RATED}")
def a03_engagement_rate(spark, d):
    return _latest_rated(spark, d).select("item_id", F.round("rate", 6).alias("rate"))


@query(f"SELECT topic_leaf_id, count(*) AS n FROM {EVENTS} WHERE topic_leaf_id IS NOT NULL GROUP BY topic_leaf_id HAVING count(*) >= 8 AND max(first_seen_at) - min(first_seen_at) >= INTERVAL 4 DAY")
def a07_chronic_topics(spark, d):
    e = A.news_events(spark, d, "topic_leaf_id", "first_seen_at").where("topic_leaf_id is not null")
    g = e.groupBy("topic_leaf_id").agg(F.count("*").alias("n"), (F.max("first_seen_at") - F.min("first_seen_at")).alias("span"))
    return g.where(F.expr("n >= 8 and span >= interval 4 days")).select("topic_leaf_id", "n")


@query(f"SELECT source_id, sum({_case('kind', KINDS)}) AS score, count(*) FILTER (kind = 'confirmed') AS confirmed, count(*) AS n FROM {JOURNAL} GROUP BY source_id")
def a08_reputation(spark, d):
    j = A.journal(spark, d)
    weight = F.coalesce(_map(F.col("kind"), KINDS), F.lit(0.0))
    return j.groupBy("source_id").agg(F.sum(weight).alias("score"), F.count_if(F.col("kind") == "confirmed").alias("confirmed"), F.count("*").alias("n"))


_TREE = """WITH RECURSIVE ev AS (SELECT o_orderkey AS id, c_nationkey AS nation, r.n_regionkey AS region, o_custkey AS cust, exp(-greatest(0, epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(o_orderdate)) / 3600 / 2400.0) AS w
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation r ON r.n_nationkey = c_nationkey),
up AS (SELECT 0 AS depth, region AS node, w FROM ev UNION ALL SELECT 1, nation, w FROM ev UNION ALL SELECT 2, cust, w FROM ev),
g AS (SELECT depth, node, sum(w) AS heat, count(*) AS events FROM up GROUP BY depth, node),"""


@query(_TREE + """b AS (SELECT depth, min(heat) AS lo, max(heat) AS hi FROM g GROUP BY depth)
SELECT g.depth, CAST(node AS BIGINT) AS node, events, round(CASE WHEN hi > lo THEN (heat - lo) / (hi - lo) ELSE 0.5 END, 4) AS heat FROM g JOIN b ON b.depth = g.depth""")
def a09_node_heat(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    w = scores.recency_weight("o_orderdate", F.expr("timestamp '1998-08-02 00:00:00'"), 2400.0)
    # summed per leaf first, so that the roll-up to ancestors moves one row per leaf
    leaf = o.groupBy("o_custkey").agg(F.sum(w).alias("w"), F.count("*").alias("n")).join(c, "o_custkey").join(n, "c_nationkey")
    levels = F.array(*[F.struct(F.lit(i).alias("depth"), F.col(k).cast("bigint").alias("node")) for i, k in enumerate(("n_regionkey", "c_nationkey", "o_custkey"))])
    g = leaf.select("w", "n", F.explode(levels).alias("at")).groupBy("at.depth", "at.node").agg(F.sum("w").alias("heat_"), F.sum("n").alias("events"))
    bounds = g.groupBy("depth").agg(F.min("heat_").alias("lo"), F.max("heat_").alias("hi"))
    return g.join(bounds, "depth").select("depth", "node", "events", F.round(scores.min_max("heat_", F.col("lo"), F.col("hi")), 4).alias("heat"))


@query("""SELECT array_to_string(p, '/') AS path, count(*) AS event_count, CAST(len(p) AS INT) AS depth FROM (SELECT id, (k)[1:n] AS p FROM (SELECT id, k, unnest(range(1, least(len(k), 5) + 1)) AS n FROM (SELECT DISTINCT id, keywords AS k FROM news_events WHERE len(keywords) > 0))) GROUP BY p""")
def a11_taxonomy_build(spark, d):
    e = A.news_events(spark, d, "keywords").where("size(keywords) > 0")
    p = e.select("id", F.explode(R.prefixes("keywords")).alias("p"))
    return p.groupBy("p").agg(F.count("*").alias("event_count")).select(F.array_join("p", "/").alias("path"), "event_count", F.size("p").alias("depth"))


@query("""SELECT label, pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, pos""")
def a18_centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", (F.col("pos") + 1).cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00') AS published, count(*) FILTER (o_orderstatus = 'O') AS drafts FROM orders")
def a19_published_recently(spark, d):
    p = A.publications(spark, d)
    return p.agg(F.count_if(F.expr("status = 'F' and published_at >= timestamp '1996-01-01 00:00:00'")).alias("published"), F.count_if(F.col("status") == "O").alias("drafts"))


@query(f"SELECT tier, name, max(subscribers) AS subscribers FROM {SUBS} GROUP BY tier, name")
def a20_source_sizes(spark, d):
    return A.source_metrics(spark, d).groupBy("tier", "name").agg(F.max("subscribers").alias("subscribers"))


@query(f"SELECT story_id, count(*) AS events, count(*) >= 3 AS tagged FROM {EVENTS} WHERE story_id IS NOT NULL GROUP BY story_id")
def a21_story_sizes(spark, d):
    return A.news_events(spark, d, "story_id").where("story_id is not null").groupBy("story_id").agg(F.count("*").alias("events")).withColumn("tagged", F.col("events") >= 3)


@query(f"SELECT content_hash, count(*) AS n, min(id) AS first_id FROM {ITEMS} GROUP BY content_hash HAVING count(*) > 1")
def a22_hash_groups(spark, d):
    return A.items(spark, d, "content_hash").groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query(f"SELECT id, CASE lower(trim(rubric)) WHEN 'war' THEN 'critical' WHEN 'politics' THEN 'high' WHEN 'sport' THEN 'low' WHEN 'culture' THEN 'low' ELSE 'high' END AS level FROM {EVENTS}")
def a24_risk_level(spark, d):
    e = A.news_events(spark, d, "rubric")
    return e.select("id", scores.risk_level(F.array_compact(F.array("rubric")), {"war": "critical", "politics": "high", "sport": "low", "culture": "low"}).alias("level"))


# ---- joins -------------------------------------------------------------------------------


@query(f"SELECT s.tier, s.kind, count(*) AS items, count(DISTINCT i.source_id) AS sources FROM {ITEMS} i JOIN sources s ON s.id = i.source_id GROUP BY s.tier, s.kind")
def j01_items_by_source(spark, d):
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "tier", "kind")
    return A.items(spark, d, "source_id").join(s, "source_id").groupBy("tier", "kind").agg(F.count("*").alias("items"), F.countDistinct("source_id").alias("sources"))


@query(f"SELECT s.name, i.lang, count(*) AS polls, sum(m.views) AS views FROM (SELECT DISTINCT id, item_id, views FROM item_metrics) m JOIN {ITEMS} i ON i.id = m.item_id JOIN sources s ON s.id = i.source_id GROUP BY s.name, i.lang")
def j02_metric_chain(spark, d):
    m = table(spark, d, "item_metrics").select("id", "item_id", "views").dropDuplicates(["id"])
    # one row per item before the chain: the pinned post's polls are summed where they lie
    per = m.groupBy("item_id").agg(F.count("*").alias("polls"), F.sum("views").alias("views"))
    i = A.items(spark, d, "source_id", "lang").withColumnRenamed("id", "item_id")
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "name")
    return per.join(i, "item_id").join(s, "source_id").groupBy("name", "lang").agg(F.sum("polls").alias("polls"), F.sum("views").alias("views"))


@query(f"SELECT id FROM {EVENTS} WHERE id NOT IN (SELECT event_id FROM merge_verdicts)")
def j03_without_verdict(spark, d):
    return R.without(A.news_events(spark, d, "status"), table(spark, d, "merge_verdicts").select(F.col("event_id").alias("id")), ["id"]).select("id")


@query(f"SELECT id FROM {EVENTS} WHERE id IN (SELECT event_id FROM merge_verdicts WHERE mode = 'auto')")
def j04_with_auto_verdict(spark, d):
    v = table(spark, d, "merge_verdicts").where("mode = 'auto'").select(F.col("event_id").alias("id"))
    return R.with_partner(A.news_events(spark, d, "status"), v, ["id"]).select("id")


@query("""WITH c AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, pos) GROUP BY label),
s AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) AS cosine FROM embeddings e, c)
SELECT vec_id, label AS nearest, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 9) DESC, label) AS rn FROM s) WHERE rn = 1""")
def j05_nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("v"))
    # the centroids, one per label of a fixed vocabulary, travel as one array
    all_ = c.agg(F.collect_list(F.struct("label", "v")).alias("centroids"))
    best = F.array_max(F.transform("centroids", lambda x: F.struct(F.round(scores.cosine(F.col("embedding"), x["v"]), 9).alias("cosine"), (-x["label"]).alias("minus"))))
    return e.select("vec_id", "embedding", F.lit(1).alias("one")).join(F.broadcast(all_.withColumn("one", F.lit(1))), "one").select("vec_id", best.alias("b")).select(
        "vec_id", (-F.col("b.minus")).alias("nearest"), F.round("b.cosine", 4).alias("cosine")
    )


@query(f"""SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, bit_count(xor(a.simhash, b.simhash)) AS distance FROM {ITEMS} a JOIN {ITEMS} b ON a.id < b.id AND a.source_id = b.source_id AND bit_count(xor(a.simhash, b.simhash)) <= 6""")
def j07_hamming_pairs(spark, d):
    """J7 within each source: the source is part of the lookup keys."""
    return R.hamming_pairs(A.items(spark, d, "source_id", "simhash"), "id", "simhash", 6, "source_id")


@query(f"SELECT id, earlier FROM (SELECT id, fetched_at, lag(id) OVER w AS earlier, lag(fetched_at) OVER w AS then_at FROM {ITEMS} WHERE content_hash IS NOT NULL AND ({NORM['title']} <> '' OR {NORM['text']} <> '') AND deleted_at IS NULL WINDOW w AS (PARTITION BY content_hash ORDER BY id)) WHERE then_at >= fetched_at - INTERVAL 72 HOUR")
def j09_earlier_same_hash(spark, d):
    """The last earlier post of the same text, if it was fetched no more than 72 hours before; blank and deleted posts take no part."""
    told = (text.normalize_text("title") != "") | (text.normalize_text("text") != "")
    i = table(spark, d, "news_items").where(F.expr("content_hash is not null and deleted_at is null") & told).select("id", "content_hash", "fetched_at").dropDuplicates(["id"])
    w = Window.partitionBy("content_hash").orderBy("id")
    met = i.select("id", "fetched_at", F.lag("id").over(w).alias("earlier"), F.lag("fetched_at").over(w).alias("then_at"))
    return met.where(F.expr("then_at >= fetched_at - interval 72 hours")).select("id", "earlier")


def j07_hamming_all(spark, d):
    """The operator's whole job: a distance of at most 6 over all rows, whatever their source. SQL would compare all pairs."""
    return R.hamming_pairs(A.items(spark, d, "simhash"), "id", "simhash", 6)


BOTH["j07_hamming_all"] = (j07_hamming_all, None)


@query(f"""SELECT a.id AS item_id, b.id AS source_item FROM (SELECT id, lower(trim(forwarded_from)) AS k FROM {ITEMS} WHERE trim(coalesce(forwarded_from, '')) <> '') a JOIN (SELECT id, lower(trim(name)) AS k FROM sources) b ON b.k = a.k""")
def j11_forwarded_from_source(spark, d):
    i = A.items(spark, d, "forwarded_from").select(F.col("id").alias("item_id"), text.key_of("forwarded_from").alias("k")).where("k is not null")
    s = A.sources(spark, d).select(F.col("id").alias("source_item"), F.lower(F.trim("name")).alias("k"))
    return i.join(s, "k").select("item_id", "source_item")


@query(f"""SELECT a.id, count(b.id) AS recent FROM {EVENTS} a LEFT JOIN {EVENTS} b ON b.story_id = a.story_id AND b.first_seen_at < a.first_seen_at AND b.first_seen_at >= a.first_seen_at - INTERVAL 48 HOUR WHERE a.story_id IS NOT NULL AND a.first_seen_at IS NOT NULL GROUP BY a.id""")
def j14_cooldown_counts(spark, d):
    e = A.news_events(spark, d, "story_id", "first_seen_at").where("story_id is not null and first_seen_at is not null")
    micros = F.unix_micros("first_seen_at")
    w = Window.partitionBy("story_id").orderBy(micros).rangeBetween(-48 * 3600 * 1000000, -1)
    return e.select("id", F.count("*").over(w).alias("recent"))


@query(f"""SELECT e.id, count(v.id) AS verdicts, bool_or(v.mode = 'auto') AS auto FROM {EVENTS} e JOIN (SELECT DISTINCT id, event_id, mode FROM merge_verdicts) v ON v.event_id = e.id GROUP BY e.id""")
def j18_candidates(spark, d):
    v = table(spark, d, "merge_verdicts").select(F.col("id").alias("v"), F.col("event_id").alias("id"), "mode").distinct()
    return A.news_events(spark, d, "status").join(v, "id").groupBy("id").agg(F.count("v").alias("verdicts"), F.bool_or(F.col("mode") == "auto").alias("auto"))


@query(f"SELECT id FROM {ITEMS} i WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_items r WHERE r.external_id = CAST(i.id AS VARCHAR))")
def j19_string_keys(spark, d):
    i = A.items(spark, d, "url").where("url is not null").withColumn("external_id", F.col("id").cast("string"))
    return R.without(i, table(spark, d, "raw_items"), ["external_id"]).select("id")


# ---- ranks, sorts, sets ------------------------------------------------------------------


@query(f"SELECT item_id, id, forwards FROM {_LATEST}")
def w01_latest_snapshot(spark, d):
    return R.latest(A.metrics(spark, d), ["item_id"], F.desc("measured_at"), F.desc("id")).select("item_id", "id", "forwards")


@query(f"SELECT source_id, id, CAST(rn AS INT) AS rank FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC NULLS LAST, id) AS rn FROM {ITEMS}) WHERE rn <= 5")
def w04_top_k(spark, d):
    return R.top_k(A.items(spark, d, "source_id", "published_at"), ["source_id"], 5, F.desc_nulls_last("published_at"), F.col("id")).select("source_id", "id", "rank")


@query(f"SELECT id, story_id, CAST(row_number() OVER (PARTITION BY story_id ORDER BY created_at, id) AS INT) AS version FROM {EVENTS} WHERE story_id IS NOT NULL")
def w06_versions(spark, d):
    e = A.news_events(spark, d, "story_id", "created_at").where("story_id is not null")
    return e.select("id", "story_id", F.row_number().over(Window.partitionBy("story_id").orderBy("created_at", "id")).alias("version"))


@query("""SELECT id, event_id, mode FROM (SELECT *, row_number() OVER w AS rn, lag(mode) OVER w AS last FROM (SELECT DISTINCT id, event_id, mode, created_at FROM merge_verdicts) WINDOW w AS (PARTITION BY event_id ORDER BY created_at, id)) WHERE rn = 1 OR last IS DISTINCT FROM mode""")
def w07_decision_changes(spark, d):
    v = table(spark, d, "merge_verdicts").select("id", "event_id", "mode", "created_at").distinct()
    return R.changes(v, ["event_id"], ["created_at", "id"], "mode").select("id", "event_id", "mode")


@query(f"SELECT story_id, arg_min(left(title, 200), id) AS title FROM {EVENTS} WHERE story_id IS NOT NULL AND trim(coalesce(title, '')) <> '' GROUP BY story_id")
def w08_first_title(spark, d):
    e = A.news_events(spark, d, "story_id", "title").where("story_id is not null and trim(coalesce(title, '')) <> ''")
    return e.groupBy("story_id").agg(F.min_by(F.left("title", F.lit(200)), "id").alias("title"))


@query(f"SELECT id, round(exp(-greatest(0, epoch({AS_OF}) - epoch(first_seen_at)) / 3600 / 48.0), 6) AS weight FROM {EVENTS} WHERE first_seen_at IS NOT NULL")
def w09_recency(spark, d):
    e = A.news_events(spark, d, "first_seen_at").where("first_seen_at is not null")
    return e.select("id", F.round(scores.recency_weight("first_seen_at", F.expr(AS_OF), 48.0), 6).alias("weight"))


@query(f"SELECT id FROM {EVENTS} WHERE significance IS NULL ORDER BY id LIMIT 25")
def l01_batch_pick(spark, d):
    return A.news_events(spark, d, "significance").where("significance is null").orderBy("id").limit(25).select("id")


@query(f"SELECT id, significance FROM {EVENTS} ORDER BY significance DESC NULLS LAST, id LIMIT 60")
def l02_most_significant(spark, d):
    return A.news_events(spark, d, "significance").orderBy(F.desc_nulls_last("significance"), "id").limit(60)


@query(f"SELECT name, item_id, round(rate, 6) AS rate FROM {_RATED} ORDER BY rate DESC, name DESC, item_id DESC LIMIT 10")
def l05_top_engagement(spark, d):
    return _latest_rated(spark, d).orderBy(F.desc("rate"), F.desc("name"), F.desc("item_id")).limit(10).select("name", "item_id", F.round("rate", 6).alias("rate"))


@query("SELECT id, label, heat FROM (SELECT DISTINCT id, label, depth, heat, heat_events FROM taxonomy_nodes) WHERE depth >= 1 AND heat <> 0 ORDER BY heat DESC, heat_events DESC, id LIMIT 20")
def l06_hottest_nodes(spark, d):
    t = table(spark, d, "taxonomy_nodes").select("id", "label", "depth", "heat", "heat_events").distinct()
    return t.where("depth >= 1 and heat <> 0").orderBy(F.desc("heat"), F.desc("heat_events"), "id").limit(20).select("id", "label", "heat")


@query("SELECT DISTINCT k AS key FROM (SELECT lower(trim(forwarded_from)) AS k FROM news_items INTERSECT SELECT lower(trim(name)) FROM sources) WHERE k <> ''")
def u01_shared_keys(spark, d):
    a = table(spark, d, "news_items").select(text.key_of("forwarded_from").alias("key"))
    return a.intersect(A.sources(spark, d).select(text.key_of("name").alias("key"))).where("key is not null")


@query("SELECT content_hash FROM raw_items EXCEPT SELECT content_hash FROM news_items")
def u03_new_hashes(spark, d):
    return table(spark, d, "raw_items").select("content_hash").subtract(table(spark, d, "news_items").select("content_hash"))


# ---- states and reports ------------------------------------------------------------------

_ARRIVALS = "(SELECT source_id, external_id, id, content_hash FROM news_items UNION SELECT source_id, external_id, id, content_hash FROM raw_items)"


@query(f"""SELECT source_id, external_id, id, CAST(row_number() OVER (PARTITION BY source_id, external_id ORDER BY id) AS INT) AS version FROM
(SELECT *, lag(content_hash) OVER w AS before, row_number() OVER w AS rn FROM {_ARRIVALS} WINDOW w AS (PARTITION BY source_id, external_id ORDER BY id)) WHERE rn = 1 OR before IS DISTINCT FROM content_hash""")
def t01_versions(spark, d):
    c = ["source_id", "external_id", "id", "content_hash"]
    arrivals = table(spark, d, "news_items").select(*c).union(table(spark, d, "raw_items").select(*c)).distinct()
    return R.versions(arrivals, ["source_id", "external_id"], ["id"], "content_hash").select("source_id", "external_id", "id", "version")


@query(f"SELECT id FROM (SELECT DISTINCT id, state, last_event_at FROM stories) WHERE state IN ('new', 'developing', 'stable') AND last_event_at < {AS_OF} - INTERVAL 5 DAY")
def t06_dormant_stories(spark, d):
    s = table(spark, d, "stories").select("id", "state", "last_event_at").distinct()
    return s.where(F.col("state").isin("new", "developing", "stable") & F.expr(f"last_event_at < {AS_OF} - interval 5 days")).select("id")


@query("""WITH RECURSIVE p AS (SELECT event_id AS e, min(canonical_event_id) AS c FROM merge_verdicts WHERE lower(trim(action)) = 'duplicate' AND canonical_event_id > 0 AND canonical_event_id < event_id GROUP BY event_id),
w(e, c) AS (SELECT e, c FROM p UNION ALL SELECT w.e, p.c FROM w JOIN p ON p.e = w.c) SELECT e AS event_id, min(c) AS canonical_id FROM w GROUP BY e""")
def t12_merge_chains(spark, d):
    v = table(spark, d, "merge_verdicts").where("lower(trim(action)) = 'duplicate' and canonical_event_id > 0").select("event_id", F.col("canonical_event_id").alias("canonical_id"))
    return R.resolve_chains(v, "event_id", "canonical_id")


@query(f"SELECT tier, count(*) AS n, count(*) FILTER (active) AS active, count(*) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY) AS recent FROM sources GROUP BY tier")
def r05_subscriptions(spark, d):
    return A.sources(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_if("active").alias("active"), F.count_if(F.expr(f"created_at >= {AS_OF} - interval 30 days")).alias("recent"))


@query(f"SELECT id, title, status, first_seen_at FROM {EVENTS} WHERE first_seen_at IS NOT NULL ORDER BY first_seen_at DESC, id DESC LIMIT 20")
def r02_recent(spark, d):
    return A.news_events(spark, d, "title", "status", "first_seen_at").where("first_seen_at is not null").orderBy(F.desc("first_seen_at"), F.desc("id")).limit(20)


@query("""SELECT event_id, id, action, mode FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT DISTINCT id, event_id, action, mode, created_at FROM merge_verdicts)) WHERE rn = 1""")
def r06_latest_verdict(spark, d):
    v = table(spark, d, "merge_verdicts").select("id", "event_id", "action", "mode", "created_at").distinct()
    return R.latest(v, ["event_id"], F.desc("created_at"), F.desc("id")).select("event_id", "id", "action", "mode")


QUERIES = {n: f for n, (f, _) in BOTH.items()}
ORACLES = {n: s for n, (_, s) in BOTH.items() if s}
