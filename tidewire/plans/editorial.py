"""Queries over events, their posts, publications and images, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import parsers, scores, text
from tidewire.operators import clusters, hierarchy, relational as R
from tidewire.plans import adapters as A
from tidewire.plans import linked as L
from tidewire.plans.linked import AUDIENCE, LINKS, MEDIA, NOW, PUBS
from tidewire.plans.reference import EVENTS, ITEMS, NORM
from tidewire.session import table

BOTH: dict = {}
#: What a source's record counts.
KIND_WEIGHTS = {"first": 2.0, "confirmed": 3.0, "leak_confirmed": 2.0, "copy": -0.5, "refuted": -4.0, "leak_refuted": -3.0}
NET_COSINE, NET_HAMMING, TOP = 0.55, 6, 5


def query(sql: str | None):
    def add(f):
        BOTH[f.__name__] = (f, sql)
        return f

    return add


# ---- signals of two events (J10, J21, A23, F22, X12, X37, W4) ------------------------------

_SIGS = f"""sigs AS (SELECT l.event_id, i.id AS item_id, CASE WHEN {NORM['title']} <> '' OR {NORM['text']} <> '' THEN i.content_hash END AS h, CASE WHEN {NORM['title']} <> '' OR {NORM['text']} <> '' THEN i.simhash END AS s,
 nullif(lower(trim(coalesce(i.forwarded_from, ''))), '') AS f, nullif(lower(trim(coalesce(i.url, ''))), '') AS u FROM {LINKS} l JOIN {ITEMS} i ON i.id = l.item_id),
keys AS (SELECT DISTINCT * FROM (SELECT event_id, 'hash' AS kind, h AS k FROM sigs UNION ALL SELECT event_id, 'forward', f FROM sigs UNION ALL SELECT event_id, 'url', u FROM sigs) WHERE k IS NOT NULL),
seen AS (SELECT id, story_id, first_seen_at FROM {EVENTS} WHERE first_seen_at IS NOT NULL),
shared AS (SELECT a.event_id, b.event_id AS candidate_id, bool_or(a.kind = 'hash') AS exact_hash, bool_or(a.kind = 'forward') AS forward_match, bool_or(a.kind = 'url') AS url_match
 FROM keys a JOIN keys b ON a.kind = b.kind AND a.k = b.k AND a.event_id <> b.event_id JOIN seen x ON x.id = a.event_id JOIN seen y ON y.id = b.event_id
 WHERE b.event_id IN (SELECT event_id FROM {PUBS} WHERE status IN ('draft', 'published')) AND y.first_seen_at <= x.first_seen_at AND y.first_seen_at >= x.first_seen_at - INTERVAL 72 HOUR GROUP BY 1, 2),
told AS (SELECT x.id AS event_id, y.id AS candidate_id FROM seen x JOIN seen y ON y.story_id = x.story_id AND y.id <> x.id AND y.first_seen_at <= x.first_seen_at AND y.first_seen_at >= x.first_seen_at - INTERVAL 72 HOUR
 WHERE y.id IN (SELECT event_id FROM {PUBS} WHERE status IN ('draft', 'published'))),
pairs AS (SELECT event_id, candidate_id FROM shared UNION SELECT event_id, candidate_id FROM told),
least_ AS (SELECT p.event_id, p.candidate_id, min(bit_count(xor(a.s, b.s))) AS distance FROM pairs p JOIN sigs a ON a.event_id = p.event_id JOIN sigs b ON b.event_id = p.candidate_id WHERE a.s IS NOT NULL AND b.s IS NOT NULL GROUP BY 1, 2),
cent AS (SELECT DISTINCT e.id, CAST(s.centroid AS DOUBLE[]) AS v FROM seen e JOIN (SELECT DISTINCT id, centroid FROM stories WHERE len(centroid) = 64) s ON s.id = e.story_id),
signals AS (SELECT p.event_id, p.candidate_id, coalesce(s.exact_hash, false) AS exact_hash, coalesce(s.forward_match, false) AS forward_match, coalesce(s.url_match, false) AS url_match, l.distance,
 CASE WHEN list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x)) = 0 THEN 0.0 ELSE round(list_cosine_similarity(a.v, b.v), 4) END AS cosine
 FROM pairs p LEFT JOIN shared s USING (event_id, candidate_id) LEFT JOIN least_ l USING (event_id, candidate_id) LEFT JOIN cent a ON a.id = p.event_id LEFT JOIN cent b ON b.id = p.candidate_id),
classed AS (SELECT *, CASE WHEN exact_hash THEN 'auto_duplicate' WHEN forward_match OR url_match OR coalesce(cosine >= 0.55, false) OR coalesce(distance <= 6, false) THEN 'grey' ELSE 'separate' END AS class FROM signals)
"""


def _signatures(spark, d):
    """(event_id, item_id, h, s, f, u): hash and signature only of posts with text."""
    i = A.items(spark, d, "content_hash", "simhash", "forwarded_from", "url", "title", "text").withColumnRenamed("id", "item_id")
    told = (text.normalize_text("title") != "") | (text.normalize_text("text") != "")
    i = i.select("item_id", F.when(told, F.col("content_hash")).alias("h"), F.when(told, F.col("simhash")).alias("s"), text.key_of("forwarded_from").alias("f"), text.key_of("url").alias("u"))
    return L.links(spark, d).select("event_id", "item_id").join(i, "item_id")


def _signals(spark, d):
    """(event_id, candidate_id, exact_hash, forward_match, url_match, distance, cosine).

    Candidates are earlier events of the last 72 hours with a draft or published publication that
    share a key or the story. A key's events are joined by day, each candidate standing in the
    four days it can serve, so that a channel forwarded for months isn't one group.
    """
    sig = _signatures(spark, d)
    seen = A.news_events(spark, d, "story_id", "first_seen_at").where("first_seen_at is not null").withColumnRenamed("id", "event_id")
    out = L.publications(spark, d).where("status in ('draft', 'published')").select("event_id").distinct()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("k")) for k, c in (("hash", "h"), ("forward", "f"), ("url", "u"))])
    keys = sig.select("event_id", F.explode(kinds).alias("x")).select("event_id", "x.kind", "x.k").where("k is not null").distinct()
    keys = keys.join(seen, "event_id").select("event_id", "kind", "k", "first_seen_at")
    keys = keys.unionByName(seen.where("story_id is not null").select("event_id", F.lit("story").alias("kind"), F.col("story_id").cast("string").alias("k"), "first_seen_at"))
    new = keys.select("event_id", "kind", "k", F.col("first_seen_at").alias("at"), F.to_date("first_seen_at").alias("day"))
    old = keys.join(out, "event_id", "left_semi").select(F.col("event_id").alias("candidate_id"), "kind", "k", F.col("first_seen_at").alias("then"), F.explode(F.sequence(F.to_date("first_seen_at"), F.date_add(F.to_date("first_seen_at"), 3))).alias("day"))
    met = new.join(old, ["kind", "k", "day"]).where(F.expr("event_id <> candidate_id and then <= at and then >= at - interval 72 hours"))
    flag = lambda kind: F.bool_or(F.col("kind") == kind)
    pairs = met.groupBy("event_id", "candidate_id").agg(flag("hash").alias("exact_hash"), flag("forward").alias("forward_match"), flag("url").alias("url_match"))
    codes = sig.where("s is not null").groupBy("event_id").agg(F.collect_set("s").alias("codes"))  # an event's posts: bounded by a day's posts per event
    a, b = codes.select("event_id", F.col("codes").alias("ca")), codes.select(F.col("event_id").alias("candidate_id"), F.col("codes").alias("cb"))
    st = table(spark, d, "stories").where("size(centroid) = 64").select(F.col("id").alias("story_id"), F.col("centroid").alias("v")).dropDuplicates(["story_id"])
    cent = seen.select("event_id", "story_id").join(st, "story_id").select("event_id", "v")
    near = F.array_min(F.flatten(F.transform("ca", lambda x: F.transform("cb", lambda y: text.hamming(x, y)))))
    return (
        pairs.join(a, "event_id", "left").join(b, "candidate_id", "left").join(cent.withColumnRenamed("v", "va"), "event_id", "left")
        .join(cent.select(F.col("event_id").alias("candidate_id"), F.col("v").alias("vb")), "candidate_id", "left")
        .select("event_id", "candidate_id", "exact_hash", "forward_match", "url_match", near.alias("distance"), F.round(scores.cosine("va", "vb"), 4).alias("cosine"))
    )


def _classed(spark, d):
    net = F.col("forward_match") | F.col("url_match") | F.coalesce(F.col("cosine") >= NET_COSINE, F.lit(False)) | F.coalesce(F.col("distance") <= NET_HAMMING, F.lit(False))
    return _signals(spark, d).withColumn("class", F.when(F.col("exact_hash"), "auto_duplicate").when(net, "grey").otherwise("separate"))


@query("WITH " + _SIGS + "SELECT event_id, candidate_id, exact_hash, forward_match, url_match FROM shared")
def j10_shared_signals(spark, d):
    return _signals(spark, d).where("exact_hash or forward_match or url_match").select("event_id", "candidate_id", "exact_hash", "forward_match", "url_match")


@query("WITH " + _SIGS + "SELECT event_id, candidate_id, distance FROM least_")
def a23_least_distance(spark, d):
    return _signals(spark, d).where("distance is not null").select("event_id", "candidate_id", F.col("distance").cast("bigint").alias("distance"))


@query("WITH " + _SIGS + "SELECT event_id, candidate_id, class, cosine, distance FROM classed")
def x12_signal_classes(spark, d):
    return _classed(spark, d).select("event_id", "candidate_id", "class", "cosine", F.col("distance").cast("bigint").alias("distance"))


@query("WITH " + _SIGS + f"""SELECT event_id, candidate_id, class, CAST(rn AS INT) AS rank FROM (SELECT c.*, row_number() OVER (PARTITION BY event_id ORDER BY exact_hash OR forward_match DESC, p.event_id_ IS NOT NULL DESC, coalesce(cosine, 0) DESC, coalesce(distance, 999), candidate_id) AS rn
FROM classed c LEFT JOIN (SELECT event_id AS event_id_ FROM {PUBS} WHERE status = 'published') p ON p.event_id_ = c.candidate_id WHERE class <> 'separate') WHERE rn <= {TOP}""")
def f22_candidate_net(spark, d):
    out = L.publications(spark, d).where("status = 'published'").select(F.col("event_id").alias("candidate_id"), F.lit(True).alias("is_out")).distinct()
    net = _classed(spark, d).where("class <> 'separate'").join(out, "candidate_id", "left")
    order = (F.desc(F.col("exact_hash") | F.col("forward_match")), F.desc(F.col("is_out").isNotNull()), F.desc(F.coalesce("cosine", F.lit(0.0))), F.coalesce("distance", F.lit(999)), F.col("candidate_id"))
    return R.top_k(net, ["event_id"], TOP, *order).select("event_id", "candidate_id", "class", "rank")


# ---- merging events (T12, U3, T13, T14) ----------------------------------------------------

_CHAIN = """RECURSIVE p AS (SELECT event_id AS e, min(canonical_event_id) AS c FROM merge_verdicts WHERE lower(trim(action)) IN ('duplicate', 'ingest_duplicate') AND canonical_event_id > 0 AND canonical_event_id < event_id GROUP BY event_id),
w(e, c) AS (SELECT e, c FROM p UNION ALL SELECT w.e, p.c FROM w JOIN p ON p.e = w.c), ends AS (SELECT e, min(c) AS keep FROM w GROUP BY e)"""


def _ends(spark, d):
    v = table(spark, d, "merge_verdicts").where("lower(trim(action)) in ('duplicate', 'ingest_duplicate') and canonical_event_id > 0")
    return R.resolve_chains(v.select("event_id", F.col("canonical_event_id").alias("keep")), "event_id", "keep")


@query(f"""WITH {_CHAIN}, l AS (SELECT * FROM {LINKS}), own AS (SELECT coalesce(ends.keep, l.event_id) AS event_id, l.item_id, l.source_id, l.role, ends.keep IS NOT NULL AS moved FROM l LEFT JOIN ends ON ends.e = l.event_id),
once AS (SELECT event_id, item_id, source_id, min(moved) AS moved, CASE WHEN bool_or(NOT moved AND role = 'origin') THEN 'origin' ELSE 'copy' END AS role FROM own GROUP BY 1, 2, 3)
SELECT o.event_id, o.item_id, o.role, o.moved FROM once o""")
def t12_merged_links(spark, d):
    """The posts of the events that remain: those of merged events move to the end of their chain, a post that is there already isn't linked twice."""
    own = L.links(spark, d).join(_ends(spark, d), "event_id", "left")
    own = own.select(F.coalesce("keep", "event_id").alias("event_id"), "item_id", "source_id", "role", F.col("keep").isNotNull().alias("moved"))
    origin = F.bool_or(~F.col("moved") & (F.col("role") == "origin"))
    return own.groupBy("event_id", "item_id", "source_id").agg(F.bool_and("moved").alias("moved"), F.when(origin, "origin").otherwise("copy").alias("role")).drop("source_id")


_MERGED_GATE = "CASE WHEN is_rumor THEN 'rumor' WHEN has_official OR is_first THEN 'confirmed' WHEN risk_level = 'low' THEN CASE WHEN high_rep THEN 'reported' ELSE 'signal' END WHEN sources >= 2 THEN 'reported' ELSE 'signal' END"


@query(f"""WITH {_CHAIN}, l AS (SELECT DISTINCT coalesce(ends.keep, l.event_id) AS event_id, l.item_id, l.source_id FROM {LINKS} l LEFT JOIN ends ON ends.e = l.event_id),
g AS (SELECT l.event_id, count(*) AS items, count(DISTINCT l.source_id) AS sources, bool_or(s.is_official OR s.tier = 'official') AS has_official, bool_or(s.tier IN ('official', 'media')) AS high_rep FROM l JOIN sources s ON s.id = l.source_id GROUP BY l.event_id),
e AS (SELECT id, risk_level, coalesce(is_rumor, false) AS is_rumor, false AS is_first FROM {EVENTS})
SELECT g.event_id, items, sources, has_official, high_rep, CASE WHEN risk_level IN ('low', 'high', 'critical') THEN {_MERGED_GATE} END AS status FROM g JOIN e ON e.id = g.event_id WHERE g.event_id IN (SELECT keep FROM ends)""")
def t12_merged_events(spark, d):
    """The evidence of each event that others were merged into, counted anew over its own and the moved posts, and the status the gate gives it."""
    ends = _ends(spark, d)
    own = L.links(spark, d).join(ends, "event_id", "left").select(F.coalesce("keep", "event_id").alias("event_id"), "item_id", "source_id").distinct()
    own = own.join(ends.select(F.col("keep").alias("event_id")).distinct(), "event_id", "left_semi")
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "is_official", "tier")
    g = own.join(s, "source_id").groupBy("event_id").agg(
        F.count("*").alias("items"), F.countDistinct("source_id").alias("sources"), F.bool_or(F.col("is_official") | (F.col("tier") == "official")).alias("has_official"), F.bool_or(F.col("tier").isin("official", "media")).alias("high_rep")
    )
    e = A.news_events(spark, d, "risk_level", "is_rumor").withColumnRenamed("id", "event_id")
    known = F.col("risk_level").isin(*scores.LEVELS)
    gate = scores.gate_decision(F.when(known, F.col("risk_level")).otherwise("low"), "sources", "has_official", F.lit(False), "high_rep", "is_rumor")
    return g.join(e, "event_id").select("event_id", "items", "sources", "has_official", "high_rep", F.when(known, gate["status"]).alias("status"))


_JOURNAL = "(SELECT DISTINCT id, event_id, lower(trim(action)) AS action, mode, created_at FROM merge_verdicts)"


@query(f"""SELECT id FROM {EVENTS} e WHERE status IN ('signal', 'reported', 'confirmed', 'rumor') AND duplicate_of IS NULL AND first_seen_at >= {NOW} - INTERVAL 60 DAY
AND id NOT IN (SELECT event_id FROM {_JOURNAL} WHERE action IN ('duplicate', 'ingest_duplicate', 'separate', 'ingest_separate')) AND id NOT IN (SELECT event_id FROM {_JOURNAL} WHERE action IN ('unresolved', 'ingest_unresolved') GROUP BY event_id HAVING count(*) >= 3)""")
def t13_to_retry(spark, d):
    """Recent events without a resolved verdict and with fewer than three unresolved ones."""
    e = A.news_events(spark, d, "status", "duplicate_of", "first_seen_at").where(F.expr(f"status in ('signal', 'reported', 'confirmed', 'rumor') and duplicate_of is null and first_seen_at >= {NOW} - interval 60 days"))
    v = table(spark, d, "merge_verdicts").select("id", F.col("event_id"), F.lower(F.trim("action")).alias("action")).distinct()
    tried = v.groupBy("event_id").agg(F.bool_or(F.col("action").isin("duplicate", "ingest_duplicate", "separate", "ingest_separate")).alias("done"), F.count_if(F.col("action").isin("unresolved", "ingest_unresolved")).alias("open"))
    stop = tried.where("done or open >= 3").select(F.col("event_id").alias("id"))
    return R.without(e, stop, ["id"]).select("id")


@query(f"SELECT story_id, rubric, min(id) AS canonical, count(*) AS n FROM {EVENTS} WHERE story_id IS NOT NULL AND rubric IS NOT NULL AND duplicate_of IS NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def t14_batch_canonicals(spark, d):
    """Groups of events of one story and rubric, as a grouper would name them, with the least id as canonical."""
    e = A.news_events(spark, d, "story_id", "rubric", "duplicate_of").where("story_id is not null and rubric is not null and duplicate_of is null")
    return e.groupBy("story_id", "rubric").agg(F.min("id").alias("canonical"), F.count("*").alias("n")).where("n >= 2")


# ---- reputation (A8, T26) and retractions (J12, T27) -----------------------------------------

_DERIVED = f"""origin AS (SELECT e.id AS event_id, e.status, coalesce(e.first_source_id, min(l.source_id)) AS source_id FROM {EVENTS} e LEFT JOIN (SELECT * FROM {LINKS} WHERE role = 'origin') l ON l.event_id = e.id WHERE e.status IN ('reported', 'confirmed', 'rumor', 'refuted') GROUP BY e.id, e.status, e.first_source_id),
derived AS (SELECT source_id, event_id, 'first' AS kind FROM origin WHERE source_id IS NOT NULL
 UNION SELECT l.source_id, l.event_id, 'copy' FROM {LINKS} l JOIN origin o ON o.event_id = l.event_id WHERE l.role = 'copy' AND l.source_id IS DISTINCT FROM o.source_id
 UNION SELECT o.source_id, o.event_id, CASE WHEN s.tier = 'leak' THEN 'leak_' ELSE '' END || o.status FROM origin o JOIN sources s ON s.id = o.source_id WHERE o.status IN ('confirmed', 'refuted'))"""


def _derived(spark, d):
    e = A.news_events(spark, d, "status", "first_source_id").where("status in ('reported', 'confirmed', 'rumor', 'refuted')").withColumnRenamed("id", "event_id")
    links = L.links(spark, d)
    named = links.where("role = 'origin'").groupBy("event_id").agg(F.min("source_id").alias("linked"))
    origin = e.join(named, "event_id", "left").select("event_id", "status", F.coalesce("first_source_id", "linked").alias("source_id"))
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "tier")
    first = origin.where("source_id is not null").select("source_id", "event_id", F.lit("first").alias("kind"))
    copies = links.where("role = 'copy'").join(origin.select("event_id", F.col("source_id").alias("o")), "event_id").where(~F.col("source_id").eqNullSafe(F.col("o"))).select("source_id", "event_id", F.lit("copy").alias("kind"))
    outcome = origin.where("status in ('confirmed', 'refuted')").join(s, "source_id").select("source_id", "event_id", F.concat(F.when(F.col("tier") == "leak", "leak_").otherwise(""), "status").alias("kind"))
    return first.union(copies).union(outcome).distinct()


@query(f"WITH {_DERIVED} SELECT * FROM derived")
def t26_reputation_journal(spark, d):
    """Who was first, who copied, and whether the origin was confirmed or refuted; each fact once."""
    return _derived(spark, d)


@query(f"WITH {_DERIVED} SELECT source_id, count(*) AS facts, sum(CASE kind WHEN 'first' THEN 2.0 WHEN 'confirmed' THEN 3.0 WHEN 'leak_confirmed' THEN 2.0 WHEN 'copy' THEN -0.5 WHEN 'refuted' THEN -4.0 WHEN 'leak_refuted' THEN -3.0 ELSE 0 END)::DOUBLE AS score FROM derived GROUP BY source_id")
def a08_reputation_scores(spark, d):
    weight = F.create_map(*[x for k, v in KIND_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return _derived(spark, d).groupBy("source_id").agg(F.count("*").alias("facts"), F.sum(weight[F.col("kind")]).alias("score"))


_RETRACTED = f"SELECT DISTINCT p.id AS publication_id, p.event_id, i.id AS item_id, i.source_id FROM {PUBS} p JOIN {LINKS} l ON l.event_id = p.event_id JOIN {ITEMS} i ON i.id = l.item_id WHERE p.status IN ('published', 'review') AND i.deleted_at IS NOT NULL"


def _retracted(spark, d):
    p = L.publications(spark, d).where("status in ('published', 'review')").select(F.col("id").alias("publication_id"), "event_id")
    gone = A.items(spark, d, "deleted_at").where("deleted_at is not null").select(F.col("id").alias("item_id"))
    return L.links(spark, d).join(gone, "item_id", "left_semi").join(p, "event_id").select("publication_id", "event_id", "item_id", "source_id").distinct()


@query(_RETRACTED)
def j12_retractions(spark, d):
    """Publications with a post that its source deleted since, once a publication and post."""
    return _retracted(spark, d)


@query(f"SELECT publication_id AS reply_to, event_id, min(item_id) AS item_id, 'draft' AS status FROM ({_RETRACTED}) GROUP BY 1, 2")
def t27_correction_drafts(spark, d):
    """One draft a publication, however many of its posts are gone."""
    return _retracted(spark, d).groupBy(F.col("publication_id").alias("reply_to"), "event_id").agg(F.min("item_id").alias("item_id")).withColumn("status", F.lit("draft"))


# ---- images (J8, J17, T24, F21, L8, A17, S10, S17, S19, S20) ----------------------------------

_REUSED = f"""SELECT a.id AS media_id, a.item_id, b.id AS earlier_id, b.item_id AS earlier_item, bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) AS distance FROM {MEDIA} a JOIN {MEDIA} b ON a.item_id <> b.item_id AND b.first_seen_at < a.first_seen_at
WHERE a.phash IS NOT NULL AND b.phash IS NOT NULL AND bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) <= 6"""


def _reused(spark, d):
    m = L.media(spark, d).where("phash is not null").select("id", "item_id", "first_seen_at", text.phash_number("phash").alias("code"))
    pairs = R.hamming_pairs(m, "id", "code", 6)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    x, y = m.select(F.col("id").alias("a"), "item_id", "first_seen_at"), m.select(F.col("id").alias("b"), F.col("item_id").alias("earlier_item"), F.col("first_seen_at").alias("then"))
    met = both.join(x, "a").join(y, "b").where("item_id <> earlier_item and then < first_seen_at")
    return met.select(F.col("a").alias("media_id"), "item_id", F.col("b").alias("earlier_id"), "earlier_item", F.col("distance").cast("bigint").alias("distance"))


@query(_REUSED)
def j08_image_archive(spark, d):
    """Each image with the strictly earlier ones of other posts within six bits, by the banded Hamming join; unreadable hashes take no part."""
    return _reused(spark, d)


@query(f"""WITH r AS ({_REUSED}), l AS (SELECT event_id, item_id FROM {LINKS}), m AS (SELECT l.event_id, m.id, m.kind, m.phash FROM l JOIN {MEDIA} m ON m.item_id = l.item_id)
SELECT m.event_id, count(DISTINCT m.id) FILTER (m.phash IS NOT NULL) AS checked, count(DISTINCT r.media_id) AS reused, CASE WHEN count(DISTINCT r.media_id) > 0 THEN 'media_reuse' ELSE 'media_clean' END AS decision
FROM m LEFT JOIN r ON r.media_id = m.id AND NOT EXISTS (SELECT 1 FROM l WHERE l.event_id = m.event_id AND l.item_id = r.earlier_item) GROUP BY m.event_id""")
def t24_media_check(spark, d):
    """Images of an event that stood in earlier posts outside it."""
    links = L.links(spark, d).select("event_id", "item_id")
    m = L.media(spark, d).select(F.col("id").alias("media_id"), "item_id", "phash").join(links, "item_id")
    found = _reused(spark, d).select("media_id", F.col("earlier_item").alias("item_id"))
    outside = m.select("event_id", "media_id").join(found, "media_id").join(links, ["event_id", "item_id"], "left_anti").select("event_id", "media_id", F.lit(True).alias("again")).distinct()
    g = m.join(outside, ["event_id", "media_id"], "left").groupBy("event_id").agg(F.countDistinct(F.when(F.col("phash").isNotNull(), F.col("media_id"))).alias("checked"), F.countDistinct(F.when(F.col("again"), F.col("media_id"))).alias("reused"))
    return g.withColumn("decision", F.when(F.col("reused") > 0, "media_reuse").otherwise("media_clean"))


@query(f"""SELECT item_id, id AS media_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY kind = 'video' DESC, CASE WHEN kind = 'image' THEN width END DESC, id) AS rn FROM {MEDIA} WHERE storage_key IS NOT NULL AND ((kind = 'video' AND size_bytes <= 50000000) OR (kind = 'image' AND size_bytes <= 10000000 AND width >= 200))) WHERE rn = 1""")
def l08_chosen_media(spark, d):
    """A post's first video, else its widest image, within the sizes that can be sent."""
    m = L.media(spark, d).where("storage_key is not null and ((kind = 'video' and size_bytes <= 50000000) or (kind = 'image' and size_bytes <= 10000000 and width >= 200))")
    best = R.latest(m, ["item_id"], F.desc(F.col("kind") == "video"), F.desc(F.when(F.col("kind") == "image", F.col("width"))), F.col("id"))
    return best.select("item_id", F.col("id").alias("media_id"), "kind")


@query(f"SELECT s.kind, count(*) AS assets, count(m.storage_key) AS stored, count(m.purged_at) AS purged, count(*) FILTER (s.kind = 'telegram' AND m.source_ref IS NOT NULL AND m.storage_key IS NULL) AS waiting FROM {MEDIA} m JOIN sources s ON s.id = m.source_id GROUP BY s.kind")
def a17_media_counts(spark, d):
    """Images by kind of source: all, stored, purged, and waiting for download."""
    per = L.media(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.count("storage_key").alias("st"), F.count("purged_at").alias("pu"), F.count_if(F.expr("source_ref is not null and storage_key is null")).alias("w"))
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "kind")
    return per.join(s, "source_id").groupBy("kind").agg(F.sum("n").alias("assets"), F.sum("st").alias("stored"), F.sum("pu").alias("purged"), F.sum(F.when(F.col("kind") == "telegram", F.col("w")).otherwise(0)).alias("waiting"))


@query(f"SELECT id AS item_id FROM {ITEMS} WHERE status IN ('accepted', 'clustered') AND url IS NOT NULL AND id NOT IN (SELECT item_id FROM {MEDIA}) AND CAST(id AS VARCHAR) NOT IN (SELECT external_id FROM raw_items WHERE external_id IS NOT NULL)")
def s17_pages_to_read(spark, d):
    """Posts past the filter with an address, no image and no journalled look at the page; here raw external ids stand for the journal's text keys."""
    i = A.items(spark, d, "status", "url").where("status in ('accepted', 'clustered') and url is not null").select(F.col("id").alias("item_id"), F.col("id").cast("string").alias("external_id"))
    return R.without(R.without(i, L.media(spark, d), ["item_id"]), table(spark, d, "raw_items"), ["external_id"]).select("item_id")


@query(f"SELECT id AS media_id FROM {MEDIA} WHERE storage_key IS NULL AND source_ref IS NOT NULL AND size_bytes <= 20000000 AND item_id IN (SELECT id FROM {ITEMS} WHERE status IN ('accepted', 'clustered'))")
def s19_media_to_fetch(spark, d):
    """Images of posts past the filter that aren't stored yet and aren't too large; what is stored is never fetched again."""
    past = A.items(spark, d, "status").where("status in ('accepted', 'clustered')").select(F.col("id").alias("item_id"))
    return L.media(spark, d).where("storage_key is null and source_ref is not null and size_bytes <= 20000000").join(past, "item_id", "left_semi").select(F.col("id").alias("media_id"))


@query(f"SELECT m.id AS media_id, m.storage_key, {NOW} AS purged_at FROM {MEDIA} m WHERE m.storage_key IS NOT NULL AND m.purged_at IS NULL AND m.item_id IN (SELECT l.item_id FROM {LINKS} l JOIN {PUBS} p ON p.event_id = l.event_id WHERE p.status = 'published')")
def s20_media_purged(spark, d):
    """Stored images of published events, stamped as purged; the key stays."""
    done = L.publications(spark, d).where("status = 'published'").select("event_id")
    used = L.links(spark, d).join(done, "event_id", "left_semi").select("item_id")
    return L.media(spark, d).where("storage_key is not null and purged_at is null").join(used, "item_id", "left_semi").select(F.col("id").alias("media_id"), "storage_key", F.expr(NOW).alias("purged_at"))


# ---- topics (A10, T29, T30, L6) ----------------------------------------------------------------

_UP = """RECURSIVE own AS (SELECT id, min(struct_pack(p := parent_id, h := heat)) AS r FROM taxonomy_nodes WHERE id IS NOT NULL GROUP BY id), up(id, anc) AS (SELECT id, id FROM own UNION SELECT u.id, o.r.p FROM up u JOIN own o ON o.id = u.anc WHERE o.r.p IN (SELECT id FROM own))"""


@query(f"WITH {_UP}, best AS (SELECT up.id, max(coalesce(o.r.h, 0)) AS heat FROM up JOIN own o ON o.id = up.anc GROUP BY up.id) SELECT e.id AS event_id, round(coalesce(b.heat, 0), 4) AS heat FROM {EVENTS} e LEFT JOIN best b ON b.id = e.topic_leaf_id")
def a10_event_heat(spark, d):
    """A10: the greatest heat on the way from an event's topic to its top; 0 without a topic. Circles are gone round once."""
    nodes = table(spark, d, "taxonomy_nodes").select("id", "parent_id", F.coalesce("heat", F.lit(0.0)).alias("heat")).where("id is not null").dropDuplicates(["id"])
    best = hierarchy.best_above(spark, nodes, "heat").select(F.col("node_id").alias("topic_leaf_id"), "best")
    e = A.news_events(spark, d, "topic_leaf_id").select(F.col("id").alias("event_id"), "topic_leaf_id")
    placed = e.where("topic_leaf_id is not null").join(best, "topic_leaf_id", "left").unionByName(e.where("topic_leaf_id is null").withColumn("best", F.lit(None).cast("double")))
    return placed.select("event_id", F.round(F.coalesce("best", F.lit(0.0)), 4).alias("heat"))


_PATHS = """RECURSIVE own AS (SELECT id, min(struct_pack(p := parent_id, l := label)) AS r, max(event_count) AS n, max(heat) AS heat, max(depth) AS depth FROM taxonomy_nodes WHERE id IS NOT NULL GROUP BY id),
down AS (SELECT id, [id] AS ids, lower(trim(coalesce(r.l, ''))) AS path FROM own WHERE r.p IS NULL OR r.p NOT IN (SELECT id FROM own) UNION ALL SELECT o.id, list_append(d.ids, o.id), d.path || ' / ' || lower(trim(coalesce(o.r.l, ''))) FROM own o JOIN down d ON o.r.p = d.id)"""
_NAMES = _PATHS.replace("lower(trim(coalesce(r.l, '')))", "split_part(lower(trim(coalesce(r.l, ''))), ' ', 1)").replace("lower(trim(coalesce(o.r.l, '')))", "split_part(lower(trim(coalesce(o.r.l, ''))), ' ', 1)")
_CONTRIBUTION = f"(SELECT topic_leaf_id AS leaf, exp(-greatest(0, epoch({NOW}) - epoch(first_seen_at)) / 3600 / 72.0) * (1 + coalesce(significance, 0)) AS w FROM {EVENTS} WHERE topic_leaf_id IS NOT NULL AND first_seen_at >= {NOW} - INTERVAL 30 DAY)"


@query(f"""WITH {_PATHS}, g AS (SELECT node, sum(w) AS raw, count(*) AS events FROM (SELECT unnest(d.ids) AS node, c.w FROM {_CONTRIBUTION} c JOIN down d ON d.id = c.leaf) GROUP BY node),
s AS (SELECT g.*, len(d.ids) - 1 AS depth FROM g JOIN down d ON d.id = g.node), b AS (SELECT depth, min(raw) AS lo, max(raw) AS hi FROM s GROUP BY depth),
h AS (SELECT node, events, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0.5 END, 4) AS heat FROM s JOIN b ON b.depth = s.depth)
SELECT o.id AS node_id, coalesce(h.heat, 0.0) AS heat, coalesce(h.events, 0) AS heat_events FROM own o LEFT JOIN h ON h.node = o.id WHERE h.node IS NOT NULL OR o.heat > 0""")
def t29_heat_refresh(spark, d):
    """Heat of the window's events rolled up to all ancestors and scaled within each depth, and 0 for nodes that were warm and aren't any more.

    An event counts exp(-age / 72 h) * (1 + its significance). Topics on circles, or below one, get none.
    """
    nodes = table(spark, d, "taxonomy_nodes")
    e = A.news_events(spark, d, "topic_leaf_id", "first_seen_at", "significance").where(F.expr(f"topic_leaf_id is not null and first_seen_at >= {NOW} - interval 30 days"))
    w = scores.recency_weight("first_seen_at", F.expr(NOW), 72.0) * (1 + F.coalesce("significance", F.lit(0.0)))
    # summed per topic before the roll-up
    leaf = e.groupBy(F.col("topic_leaf_id").alias("node_id")).agg(F.sum(w).alias("w"), F.count("*").alias("n"))
    paths = hierarchy.hierarchy(spark, nodes).where("node_depth >= 0").select("node_id", "path_ids")
    at = F.posexplode("path_ids").alias("depth", "node")
    g = leaf.join(paths, "node_id").select("w", "n", at).groupBy("node").agg(F.max("depth").alias("depth"), F.sum("w").alias("raw"), F.sum("n").alias("events"))
    bounds = g.groupBy("depth").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    h = g.join(bounds, "depth").select(F.col("node").alias("node_id"), F.round(scores.min_max("raw", F.col("lo"), F.col("hi")), 4).alias("heat"), F.col("events").alias("heat_events"))
    warm = nodes.where("heat > 0 and id is not null").select(F.col("id").alias("node_id")).distinct()
    stale = warm.join(h, "node_id", "left_anti").select("node_id", F.lit(0.0).alias("heat"), F.lit(0).cast("bigint").alias("heat_events"))
    return h.unionByName(stale)


@query(f"""WITH {_NAMES}, g AS (SELECT path, arg_max(o.id, struct_pack(n := coalesce(o.n, 0), i := -o.id)) AS canonical_id, count(*) AS members, sum(coalesce(o.n, 0))::BIGINT AS event_count FROM down d JOIN own o ON o.id = d.id GROUP BY path)
SELECT d.id AS node_id, g.canonical_id, g.members, g.event_count FROM down d JOIN g ON g.path = d.path WHERE g.members > 1""")
def t30_merged_topics(spark, d):
    """Siblings that a grouper names alike become the one with the most events (of equals the least id), and so do their children named alike, on every level: the nodes of one path of names. The grouper here takes a label's first word. Nodes on circles stay apart."""
    nodes = table(spark, d, "taxonomy_nodes")
    labels = F.transform("path_labels", lambda x: F.split_part(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit(" "), F.lit(1)))
    paths = hierarchy.hierarchy(spark, nodes).where("node_depth >= 0").select("node_id", F.array_join(labels, " / ").alias("path"))
    n = nodes.where("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.coalesce(F.max("event_count"), F.lit(0)).alias("n"))
    p = paths.join(n, "node_id")
    g = p.groupBy("path").agg(F.max_by("node_id", F.struct("n", (-F.col("node_id")).alias("i"))).alias("canonical_id"), F.count("*").alias("members"), F.sum("n").alias("event_count")).where("members > 1")
    return p.join(g, "path").select("node_id", "canonical_id", "members", "event_count")


@query(f"WITH {_PATHS} SELECT d.path, round(o.heat, 3) AS heat, o.depth FROM down d JOIN own o ON o.id = d.id WHERE o.depth >= 1 AND o.heat <> 0 ORDER BY o.heat DESC, d.id LIMIT 25")
def r03_topics(spark, d):
    """The hottest topics with their paths."""
    nodes = table(spark, d, "taxonomy_nodes")
    own = nodes.where("id is not null").groupBy(F.col("id").alias("node_id")).agg(F.max("heat").alias("heat"), F.max("depth").alias("depth"))
    p = hierarchy.hierarchy(spark, nodes).where("node_depth >= 0").select("node_id", F.array_join(F.transform("path_labels", lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))), " / ").alias("path"))
    top = own.where("depth >= 1 and heat <> 0").join(p, "node_id").orderBy(F.desc("heat"), "node_id").limit(25)
    return top.select("path", F.round("heat", 3).alias("heat"), "depth")


# ---- evidence (J6, J20, U2, J22, J23) -----------------------------------------------------------

_NEAR = """near AS (SELECT q.vec_id AS claim_id, e.vec_id AS item_id, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
legs AS (SELECT 0 AS leg, 'corpus' AS kind, *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, item_id) AS rn FROM near UNION ALL SELECT 1, 'official', *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, item_id) FROM near WHERE label IN (0, 1, 2)),
kept AS (SELECT * FROM legs WHERE rn <= 5 AND score >= CASE kind WHEN 'corpus' THEN 0.2 ELSE 0.22 END)"""


def _legs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    q = e.where("vec_id % 50 = 0").select("vec_id", "embedding")
    corpus = R.nearest_vectors(q, e, "vec_id", "embedding", 5)
    official = R.nearest_vectors(q, e.where("label in (0, 1, 2)"), "vec_id", "embedding", 5)
    both = corpus.where("score >= 0.2").select(F.lit(0).alias("leg"), F.lit("corpus").alias("kind"), "*").unionByName(official.where("score >= 0.22").select(F.lit(1).alias("leg"), F.lit("official").alias("kind"), "*"))
    return both.select("leg", "kind", F.col("query_id").alias("claim_id"), F.col("id").alias("item_id"), "score", "rank")


@query(f"WITH {_NEAR} SELECT claim_id, item_id, score FROM kept WHERE kind = 'corpus'")
def j06_corpus_evidence(spark, d):
    """For every 50th vector its five nearest others above the floor; the queries go over all rows in blocks."""
    return _legs(spark, d).where("kind = 'corpus'").select("claim_id", "item_id", "score")


@query(f"WITH {_NEAR} SELECT claim_id, kind, item_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY leg, rn) AS place FROM kept) WHERE place <= 7")
def j20_composite_evidence(spark, d):
    """The evidence of all searchers in their order, the first of a (kind, item) kept, seven a claim at most."""
    first = R.latest(_legs(spark, d), ["claim_id", "kind", "item_id"], F.col("leg"), F.col("rank"))
    return R.top_k(first.drop("rank"), ["claim_id"], 7, F.col("leg"), F.desc("score"), F.col("item_id")).select("claim_id", "kind", "item_id", F.col("rank").alias("place"))


@query(f"SELECT id AS item_id, CASE WHEN coalesce(text, '') <> '' THEN left(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 600) ELSE coalesce(trim(url), '') END AS snippet FROM {ITEMS}")
def j23_snippets(spark, d):
    """A post's text, cut at 600 characters, else its address."""
    i = A.items(spark, d, "text", "url")
    blank = F.lit(" \t\n\x0b\x0c\r")
    return i.select(F.col("id").alias("item_id"), F.when(F.coalesce("text", F.lit("")) != "", F.left(F.btrim("text", blank), F.lit(600))).otherwise(F.coalesce(F.trim("url"), F.lit(""))).alias("snippet"))


# ---- digests (F9, X19, X20, X21, T20, A25) ------------------------------------------------------

#: Name, first and last hour (the night crosses midnight), hour of publication; Kyiv time.
WINDOWS = (("night", 22, 6, 7), ("morning", 6, 14, 15), ("day", 14, 22, 22))
_DAYS = f"(SELECT DISTINCT CAST(first_seen_at AS DATE) AS day FROM {EVENTS} WHERE first_seen_at IS NOT NULL)"
_SPANS = "SELECT day, name, timezone('Europe/Kyiv', (CASE WHEN a < b THEN day ELSE day - 1 END)::TIMESTAMP + to_hours(a)) AS start_at, timezone('Europe/Kyiv', day::TIMESTAMP + to_hours(b)) AS end_at, timezone('Europe/Kyiv', day::TIMESTAMP + to_hours(c)) AS due_at FROM " + _DAYS + " d, (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in WINDOWS) + ") w(name, a, b, c)"


def _spans(spark, d):
    days = A.news_events(spark, d, "first_seen_at").where("first_seen_at is not null").select(F.to_date("first_seen_at").alias("day")).distinct()
    at = lambda day, hour: F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(hour), day.cast("timestamp")), "Europe/Kyiv")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), at(F.col("day") if a < b else F.date_sub("day", 1), a).alias("start_at"), at(F.col("day"), b).alias("end_at"), at(F.col("day"), c).alias("due_at")) for n, a, b, c in WINDOWS])
    return days.select("day", F.explode(rows).alias("w")).select("day", "w.*")


@query(_SPANS)
def x20_window_ranges(spark, d):
    """The span of each digest on each day, in UTC; a window that starts after it ends began the day before."""
    return _spans(spark, d)


@query(f"SELECT name FROM ({_SPANS}) WHERE day = CAST(TIMESTAMP '2025-03-20 14:00:00' AS DATE) AND due_at <= TIMESTAMPTZ '2025-03-20 14:00:00+00' AND name NOT IN ('night')")
def x21_due_windows(spark, d):
    """Windows whose hour of publication has passed today and that aren't done yet (the night's is)."""
    return _spans(spark, d).where("day = date '2025-03-20' and due_at <= timestamp '2025-03-20 14:00:00' and name not in ('night')").select("name")


_BLOB = "coalesce(title, '') || coalesce(chr(10) || array_to_string(list_filter(keywords, lambda x: x <> ''), chr(10)), '')"
_ATTACKS = f"""SELECT id, title, first_seen_at FROM (SELECT DISTINCT id, title, keywords, rubric, status, curated, duplicate_of, first_seen_at FROM news_events) WHERE lower(rubric) IN ('war', 'society') AND regexp_matches(lower({_BLOB}), 'ракет|дрон|обстріл|удар|attack|drohne|постраж') AND status IN ('reported', 'confirmed', 'rumor') AND duplicate_of IS NULL AND title IS NOT NULL AND first_seen_at IS NOT NULL"""


def _attacks(spark, d):
    """Events of an attack rubric with a marker in the title or in the texts of their facts, which are JSON."""
    e = A.news_events(spark, d, "title", "keywords", "rubric", "status", "curated", "duplicate_of", "first_seen_at")
    e = e.where("status in ('reported', 'confirmed', 'rumor') and duplicate_of is null and title is not null and first_seen_at is not null and lower(rubric) in ('war', 'society')")
    base = F.to_json(F.struct(F.transform("keywords", lambda k: F.struct(k.alias("text"))).alias("facts")))
    blob = F.concat_ws("\n", F.array(F.col("title")), F.transform(F.coalesce(parsers.facts(base), F.array()), lambda f: f["text"]))
    return e.where(text.any_match(F.lower(blob), ["ракет", "дрон", "обстріл", "удар", "attack", "drohne", "постраж"]))


@query(f"SELECT id FROM ({_ATTACKS}) ORDER BY first_seen_at DESC, id DESC LIMIT 200")
def t20_reserved_attacks(spark, d):
    """The 200 most recent attack reports, reserved for a digest."""
    return _attacks(spark, d).orderBy(F.desc("first_seen_at"), F.desc("id")).limit(200).select("id")


@query(f"SELECT s.day, s.name, count(*) AS n, string_agg('• ' || trim(e.title), chr(10) ORDER BY e.first_seen_at, e.id) AS body FROM ({_ATTACKS}) e JOIN ({_SPANS}) s ON e.first_seen_at >= s.start_at AND e.first_seen_at < s.end_at GROUP BY s.day, s.name")
def a25_digests(spark, d):
    """Each digest's number of reports and its text, in the order they were first seen. An event joins by its days, then by the span."""
    e = _attacks(spark, d).select("id", "title", "first_seen_at", F.explode(F.sequence(F.to_date("first_seen_at"), F.date_add(F.to_date("first_seen_at"), 1))).alias("day"))
    met = e.join(_spans(spark, d), "day").where("first_seen_at >= start_at and first_seen_at < end_at")
    lines = F.array_sort(F.collect_list(F.struct("first_seen_at", "id", F.concat(F.lit("• "), F.trim("title")).alias("line"))))
    return met.groupBy("day", "name").agg(F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))


@query(f"SELECT l.event_id, bool_or(s.is_official) AS has_official, bool_or(s.tier IN ('official', 'media')) AS high_rep FROM {LINKS} l JOIN sources s ON s.id = l.source_id GROUP BY l.event_id")
def a06_source_flags(spark, d):
    """Whether an event's posts come from an official source, or from one of good standing."""
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "is_official", "tier")
    g = L.links(spark, d).select("event_id", "source_id").distinct().join(s, "source_id").groupBy("event_id")
    return g.agg(F.bool_or("is_official").alias("has_official"), F.bool_or(F.col("tier").isin("official", "media")).alias("high_rep"))


# ---- folds (A5, A12, A13, T4): no SQL, rows depend on the order of arrival -----------------------


def a05_independent_sources(spark, d):
    """A5: sources of each event that no copy links."""
    i = A.items(spark, d, "content_hash", "simhash", "forwarded_from").withColumnRenamed("id", "item_id")
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return clusters.independent_sources(L.links(spark, d).join(i, "item_id").join(s, "source_id"))


def t04_event_clusters(spark, d):
    """T4, T5: events of a rubric that join the nearest open cluster, by the centroid of their story."""
    st = table(spark, d, "stories").where("size(centroid) = 64").select(F.col("id").alias("story_id"), F.col("centroid").alias("vector")).dropDuplicates(["story_id"])
    e = A.news_events(spark, d, "story_id", "rubric", "first_seen_at").where("rubric is not null").withColumnRenamed("first_seen_at", "at")
    return clusters.greedy_clusters(e.join(st, "story_id"), "rubric")


def a12_merged_facts(spark, d):
    """The titles of a story's events as facts; the story's centroid, forwards or backwards, stands for their vectors."""
    st = table(spark, d, "stories").where("size(centroid) = 64").select(F.col("id").alias("story_id"), "centroid").dropDuplicates(["story_id"])
    e = A.news_events(spark, d, "story_id", "title", "significance", "first_source_id").where("title is not null")
    turned = F.when(F.col("id") % 2 == 0, F.col("centroid")).otherwise(F.reverse("centroid"))
    return clusters.merged_facts(e.join(st, "story_id").select(F.col("story_id").alias("event_id"), "id", F.col("title").alias("text"), F.col("significance").alias("value"), F.col("first_source_id").alias("source_id"), turned.alias("vector")))


def a13_repeat_share(spark, d):
    """Posts of a source that repeat an earlier kept one."""
    return clusters.repeat_share(A.items(spark, d, "source_id", "simhash"), "source_id")


BOTH |= {f.__name__: (f, None) for f in (a05_independent_sources, t04_event_clusters, a12_merged_facts, a13_repeat_share)}


# ---- reports and small selections ----------------------------------------------------------------

_HEALTH = f"SELECT source_id, max(fetched_at) FILTER (status <> 'error') AS last_success, count(*) FILTER (status = 'error' AND fetched_at > coalesce(ok, TIMESTAMPTZ '1970-01-01 00:00:00+00')) AS failures FROM (SELECT source_id, fetched_at, status, max(CASE WHEN status <> 'error' THEN fetched_at END) OVER (PARTITION BY source_id) AS ok FROM {ITEMS}) GROUP BY source_id"


def _health(spark, d):
    i = A.items(spark, d, "source_id", "fetched_at", "status")
    ok = i.where("status <> 'error'").groupBy("source_id").agg(F.max("fetched_at").alias("last_success"))
    late = i.where("status = 'error'").groupBy("source_id", "fetched_at").agg(F.count("*").alias("n")).join(ok, "source_id", "left").where("last_success is null or fetched_at > last_success")
    return i.select("source_id").distinct().join(ok, "source_id", "left").join(late.groupBy("source_id").agg(F.sum("n").alias("failures")), "source_id", "left").select("source_id", "last_success", F.coalesce("failures", F.lit(0)).alias("failures"))


@query(_HEALTH)
def a14_health_fold(spark, d):
    """Each source's last successful fetch and its failures since."""
    return _health(spark, d)


@query(f"SELECT s.name, h.failures, h.last_success FROM ({_HEALTH}) h JOIN sources s ON s.id = h.source_id ORDER BY h.failures DESC, s.name, s.id LIMIT 30")
def l07_health_worst_first(spark, d):
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "name")
    return _health(spark, d).join(s, "source_id").orderBy(F.desc("failures"), "name", "source_id").limit(30).select("name", "failures", "last_success")


@query(f"SELECT source_id, arg_max(subscribers, day) AS subscribers FROM {AUDIENCE} WHERE subscribers > 0 GROUP BY source_id")
def a04_latest_audience(spark, d):
    """A4: the latest number that is not 0 or missing, per source."""
    return L.audience(spark, d).where("subscribers > 0").groupBy("source_id").agg(F.max_by("subscribers", "day").alias("subscribers"))


@query(f"SELECT id, coalesce(significance, 0) AS significance FROM {EVENTS} WHERE duplicate_of IS NULL ORDER BY coalesce(significance, 0) DESC, id LIMIT 60")
def l03_publish_scan(spark, d):
    return A.news_events(spark, d, "significance", "duplicate_of").where("duplicate_of is null").select("id", F.coalesce("significance", F.lit(0.0)).alias("significance")).orderBy(F.desc("significance"), "id").limit(60)


@query(f"SELECT p.story_id, count(*) AS n, count(DISTINCT CAST(p.published_at AS DATE)) AS days, count(*) FILTER (e.status = 'signal') AS violations, count(*) >= 2 AND count(*) FILTER (e.status = 'signal') = 0 AS auto_met FROM {PUBS} p JOIN {EVENTS} e ON e.id = p.event_id WHERE p.status = 'published' GROUP BY p.story_id")
def a16_shadow_report(spark, d):
    """Per story the published posts, the days they cover, those that the gate holds back, and whether the bar is met."""
    e = A.news_events(spark, d, "status").select(F.col("id").alias("event_id"), F.col("status").alias("gate"))
    p = L.publications(spark, d).where("status = 'published'").join(e, "event_id")
    g = p.groupBy("story_id").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("published_at")).alias("days"), F.count_if(F.col("gate") == "signal").alias("violations"))
    return g.withColumn("auto_met", (F.col("n") >= 2) & (F.col("violations") == 0))


@query(f"SELECT event_id, string_agg(action || ':' || mode, ' > ' ORDER BY id) AS decisions, count(*) AS n FROM {_JOURNAL} GROUP BY event_id")
def r10_event_journal(spark, d):
    """Each event's decisions in order."""
    v = table(spark, d, "merge_verdicts").select("id", "event_id", F.lower(F.trim("action")).alias("action"), "mode", "created_at").distinct()
    steps = F.array_sort(F.collect_list(F.struct("id", F.concat_ws(":", "action", "mode").alias("step"))))
    return v.groupBy("event_id").agg(F.array_join(F.transform(steps, lambda x: x["step"]), " > ").alias("decisions"), F.count("*").alias("n"))


@query(f"SELECT id FROM {_JOURNAL} WHERE NOT (action LIKE 'ingest%' AND created_at < {NOW} - INTERVAL 30 DAY)")
def t28_journal_kept(spark, d):
    """The journal without the old rows of one stage."""
    v = table(spark, d, "merge_verdicts").select("id", F.lower(F.trim("action")).alias("action"), "created_at").distinct()
    old = F.coalesce(F.col("action").like("ingest%") & F.expr(f"created_at < {NOW} - interval 30 days"), F.lit(False))
    return v.where(~old).select("id")


@query(f"SELECT source_id, external_id, min(deleted_at) AS deleted_at, max(edited_at) AS edited_at FROM {ITEMS} GROUP BY source_id, external_id HAVING min(deleted_at) IS NOT NULL")
def t02_deleted_posts(spark, d):
    """A post's first deletion holds; its last edit is kept."""
    i = A.items(spark, d, "source_id", "external_id", "deleted_at", "edited_at")
    return i.groupBy("source_id", "external_id").agg(F.min("deleted_at").alias("deleted_at"), F.max("edited_at").alias("edited_at")).where("deleted_at is not null")


@query(f"SELECT id AS item_id, left(CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN trim(title, ' ') ELSE trim(split_part(trim(coalesce(text, ''), ' ' || chr(10) || chr(13) || chr(9)), chr(10), 1), ' ') END, 200) AS title FROM {ITEMS}")
def w08_titles(spark, d):
    """A post's title, else the first line of its text, at most 200 characters."""
    i = A.items(spark, d, "title", "text")
    line = F.trim(F.split_part(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \n\r\t")), F.lit("\n"), F.lit(1)))
    return i.select(F.col("id").alias("item_id"), F.left(F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.trim("title")).otherwise(line), F.lit(200)).alias("title"))


@query(f"""SELECT event_id, left(string_agg(piece, chr(10) ORDER BY item_id), 2000) AS excerpt FROM (SELECT l.event_id, l.item_id, trim(coalesce(i.title, '') || chr(10) || coalesce(i.text, ''), ' ' || chr(10)) AS piece, row_number() OVER (PARTITION BY l.event_id ORDER BY l.item_id) AS rn FROM {LINKS} l JOIN {ITEMS} i ON i.id = l.item_id) WHERE rn <= 6 AND piece <> '' GROUP BY event_id""")
def x27_excerpts(spark, d):
    """What the first six posts of an event say, at most 2,000 characters."""
    six = R.top_k(L.links(spark, d), ["event_id"], 6, F.col("item_id")).select("event_id", "item_id")
    i = A.items(spark, d, "title", "text").select(F.col("id").alias("item_id"), F.btrim(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), F.lit(" \n")).alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("item_id", "piece")))
    return six.join(i, "item_id").where("piece <> ''").groupBy("event_id").agg(F.left(F.array_join(F.transform(pieces, lambda x: x["piece"]), "\n"), F.lit(2000)).alias("excerpt"))


@query("""SELECT id, array_to_string(tags, ' ') AS tags FROM (SELECT id, list_transform(list_slice(list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN list_position(k, k[i]) = i THEN k[i] END), lambda x: x IS NOT NULL), 1, 2), lambda x: '#' || x) AS tags FROM (SELECT DISTINCT id, list_filter(list_transform(keywords, lambda x: lower(trim(x))), lambda x: x <> '') AS k FROM news_events WHERE keywords IS NOT NULL)) WHERE len(tags) > 0""")
def w10_hashtags(spark, d):
    """The first two different keywords, in their order."""
    e = A.news_events(spark, d, "keywords").where("keywords is not null")
    words = F.filter(F.transform("keywords", lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return e.select("id", F.array_join(F.transform(F.slice(F.array_distinct(words), 1, 2), lambda x: F.concat(F.lit("#"), x)), " ").alias("tags")).where("tags <> ''")


@query(f"SELECT s.name, arg_min(i.url, i.id) AS url FROM (SELECT * FROM {ITEMS} WHERE url IS NOT NULL) i RIGHT JOIN sources s ON s.id = i.source_id GROUP BY s.name")
def j15_first_url(spark, d):
    """The first address of each source's posts; sources without one stay."""
    first = A.items(spark, d, "source_id", "url").where("url is not null").groupBy("source_id").agg(F.min(F.struct("id", "url")).alias("x"))
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "name")
    return s.join(first, "source_id", "left").groupBy("name").agg(F.min("x").alias("x")).select("name", F.col("x.url").alias("url"))


@query("SELECT DISTINCT '- handle: ' || h AS line FROM (SELECT lower(ltrim(trim(forwarded_from), '@')) AS h FROM news_items WHERE trim(coalesce(forwarded_from, '')) <> '') WHERE h NOT IN (SELECT lower(ltrim(trim(handle_or_url), '@')) FROM sources WHERE handle_or_url IS NOT NULL) AND h NOT IN (SELECT lower(trim(name)) FROM sources WHERE name IS NOT NULL)")
def s15_source_lines(spark, d):
    """Origins of forwarded posts that are no source yet, once each, as lines of the configuration."""
    bare = lambda c: F.lower(F.ltrim(F.trim(c), F.lit("@")))
    s = A.sources(spark, d)
    have = s.where("handle_or_url is not null").select(bare("handle_or_url").alias("h")).unionByName(s.where("name is not null").select(F.lower(F.trim("name")).alias("h")))
    new = table(spark, d, "news_items").where("trim(coalesce(forwarded_from, '')) <> ''").select(bare("forwarded_from").alias("h")).distinct()
    return new.join(have, "h", "left_anti").select(F.concat(F.lit("- handle: "), "h").alias("line"))


@query(f"SELECT id, CASE WHEN update_type IN ('new_fact', 'refutation', 'consequence') THEN 'draft' WHEN update_type IS NULL AND (story_id IS NULL OR first_seen_at < {NOW} - INTERVAL 12 HOUR) THEN 'draft' ELSE 'summary' END AS route FROM {EVENTS} WHERE status IN ('reported', 'confirmed', 'rumor') AND duplicate_of IS NULL AND curated IS DISTINCT FROM 'digest' AND coalesce(significance, 0) >= 0.3")
def f12_draftable(spark, d):
    """What may be drafted: the types that aren't only for the summary, and unclassified events without a story or past the grace."""
    e = A.news_events(spark, d, "update_type", "story_id", "first_seen_at", "status", "duplicate_of", "curated", "significance")
    e = e.where("status in ('reported', 'confirmed', 'rumor') and duplicate_of is null and not (curated <=> 'digest') and coalesce(significance, 0) >= 0.3")
    worthy = [x for x in parsers.UPDATES if x not in parsers.SUMMARY_ONLY]
    unclassified = F.col("update_type").isNull() & (F.col("story_id").isNull() | F.expr(f"coalesce(first_seen_at < {NOW} - interval 12 hours, false)"))
    return e.select("id", F.when(F.col("update_type").isin(*worthy) | unclassified, "draft").otherwise("summary").alias("route"))


@query(f"SELECT id FROM {EVENTS} WHERE status IN ('reported', 'confirmed', 'rumor') AND duplicate_of IS NULL AND (risk_level IS NULL OR risk_level IN ('high', 'critical')) AND id NOT IN (SELECT event_id FROM merge_verdicts WHERE event_id IS NOT NULL)")
def f23_to_check(spark, d):
    """events to fact-check: no verdict yet, no duplicate, a risk that is high or not known."""
    e = A.news_events(spark, d, "status", "duplicate_of", "risk_level").where("status in ('reported', 'confirmed', 'rumor') and duplicate_of is null and (risk_level is null or risk_level in ('high', 'critical'))")
    return R.without(e, table(spark, d, "merge_verdicts").select(F.col("event_id").alias("id")), ["id"]).select("id")


@query(f"SELECT id AS item_id FROM (SELECT i.id, i.published_at FROM {ITEMS} i JOIN sources s ON s.id = i.source_id WHERE s.kind = 'telegram' AND i.published_at >= {NOW} - INTERVAL 30 DAY) ORDER BY id DESC LIMIT 300")
def f15_to_measure(spark, d):
    """the newest posts of one kind of source, for the next poll."""
    s = A.sources(spark, d).where("kind = 'telegram'").select(F.col("id").alias("source_id"))
    i = A.items(spark, d, "source_id", "published_at").where(F.expr(f"published_at >= {NOW} - interval 30 days")).join(s, "source_id", "left_semi")
    return i.orderBy(F.desc("id")).limit(300).select(F.col("id").alias("item_id"))


@query(f"SELECT event_id, count(*) AS attempts FROM {_JOURNAL} GROUP BY event_id HAVING count(*) >= 3")
def a15_repeated_attempts(spark, d):
    """Events with three journalled attempts or more."""
    v = table(spark, d, "merge_verdicts").select("id", "event_id", F.lower(F.trim("action")).alias("action"), "mode", "created_at").distinct()
    return v.groupBy("event_id").agg(F.count("*").alias("attempts")).where("attempts >= 3")


@query(f"""WITH f AS (SELECT a.id, b.id AS reply_to, row_number() OVER (PARTITION BY a.id ORDER BY b.published_at DESC, b.id DESC) AS rn FROM {PUBS} a JOIN {EVENTS} e ON e.id = a.event_id JOIN {PUBS} b ON b.story_id = a.story_id AND b.status = 'published' AND b.id <> a.id AND b.published_at < e.first_seen_at WHERE a.story_id IS NOT NULL) SELECT id AS publication_id, reply_to FROM f WHERE rn = 1""")
def j13_story_reply(spark, d):
    """The last publication of the same story before an event was first seen; of equal times the larger id."""
    p = L.publications(spark, d).where("story_id is not null")
    e = A.news_events(spark, d, "first_seen_at").select(F.col("id").alias("event_id"), "first_seen_at")
    left = p.join(e, "event_id").where("first_seen_at is not null").select("story_id", F.col("id").alias("publication_id"), F.col("first_seen_at").alias("at"))
    right = p.where("status = 'published' and published_at is not null").select("story_id", F.col("published_at").alias("at_"), F.col("id").alias("reply_to"))
    # of equal times the larger id comes last: the order of the union carries it
    found = R.nearest_before(left, right.groupBy("story_id", "at_").agg(F.max("reply_to").alias("reply_to")), ["story_id"], "at", "at_", "reply_to")
    return found.where("last_reply_to is not null and last_reply_to <> publication_id").select("publication_id", F.col("last_reply_to").alias("reply_to"))
