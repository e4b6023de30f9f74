"""Queries of the editors' desk: texts and their checks, scores, selections, stores of settings, reports. Each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import parsers, scores, text
from tidewire.operators import relational as R
from tidewire.plans import adapters as A
from tidewire.plans import analytics
from tidewire.plans import linked as L
from tidewire.plans.cases import case_table
from tidewire.plans.linked import AUDIENCE, LINKS, MEDIA, NOW, PUBS
from tidewire.plans.reference import EVENTS, ITEMS
from tidewire.session import table

BOTH: dict = {}


def query(sql: str):
    def add(f):
        BOTH[f.__name__] = (f, sql)
        return f

    return add


_BLOB = "coalesce(title, '') || chr(10) || coalesce(text, '')"


def _blob():
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))


# ---- checks of texts (F3, F4, F6, F7, F18) --------------------------------------------------------

MARKERS = {"anonymous": "джерел|insider|anonym", "exclusive": "ексклюзив|exclusive|exklusiv", "urgent": "термінов|urgent|eilmeldung"}
STOP = [("denial", "спростува", "all", "block"), ("army", "штаб", "ua_side", "needs_official"), ("price", "ціна|цін ", "all", "review")]
ACCENT = {"contrast": "попри|even so|zuvor", "importance": "важлив|in the end|wichtig"}


@query("SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({_BLOB}), '{p}') THEN '{n}' END" for n, p in sorted(MARKERS.items())) + f"], lambda x: x IS NOT NULL)) AS marker FROM {ITEMS}")
def f03_markers(spark, d):
    """markers of a post, which never drop it."""
    return A.derived(spark, d, text.matched_categories(F.lower(_blob()), MARKERS).alias("m")).select("id", F.explode("m").alias("marker"))


_HITS = " UNION ALL ".join(
    f"SELECT id, '{rule}' AS rule_id, '{action}' AS action FROM (SELECT i.id, i.title, i.text, s.origin FROM {ITEMS} i JOIN sources s ON s.id = i.source_id) WHERE regexp_matches({_BLOB}, '{pattern}')" + (" AND origin = 'ua'" if scope == "ua_side" else "")
    for rule, pattern, scope, action in STOP
)


@query(_HITS)
def f04_stoplist_hits(spark, d):
    """rules that a post meets; those of one side hold for posts of that side, or of none known."""
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), F.when(F.col("origin") == "ua", "ua").otherwise("ru").alias("side"))
    i = A.items(spark, d, "source_id", "title", "text").withColumn("blob", _blob()).select("id", "source_id", "blob").join(s, "source_id")
    return i.select("id", F.explode(text.stoplist_hits("blob", "side", STOP)).alias("h")).select("id", F.col("h.name").alias("rule_id"), "h.action")


@query(f"SELECT id, regexp_matches(lower({_BLOB}), 'україн|ukrain|київ|kyiv') AS relevant FROM {ITEMS}")
def f07_relevance(spark, d):
    return A.derived(spark, d, text.any_match(F.lower(_blob()), ["україн|ukrain", "київ|kyiv"]).alias("relevant"))


@query("SELECT id, category, unnest(regexp_extract_all(t, p)) AS span FROM (SELECT id, lower(" + _BLOB + f") AS t FROM {ITEMS}), (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in ACCENT.items()) + ") c(category, p)")
def f06_accent_spans(spark, d):
    """all matches with their category."""
    return A.derived(spark, d, text.found_spans(F.lower(_blob()), ACCENT).alias("hits")).select("id", F.explode("hits").alias("h")).select("id", "h.category", "h.span")


@query(f"""SELECT id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(coalesce(title, ''), 'спростува') THEN 'stoplist_block' END, CASE WHEN is_rumor AND NOT contains(lower(left(coalesce(title, ''), 60)), 'чутка') THEN 'missing_rumor_label' END,
 CASE WHEN trim(coalesce(title, '')) = '' THEN 'empty_post' END], lambda x: x IS NOT NULL)), ',') AS hard FROM {EVENTS}""")
def f18_critic(spark, d):
    """what keeps a text from going out."""
    e = A.news_events(spark, d, "title", "is_rumor")
    t = F.coalesce("title", F.lit(""))
    why = scores.blocked_reasons(stoplist_block=t.contains("спростува"), missing_rumor_label=F.col("is_rumor") & ~F.lower(F.left(t, F.lit(60))).contains("чутка"), empty_post=F.trim(t) == "")
    return e.select("id", F.array_join(why, ",").alias("hard"))


# ---- scores and routes (X10, T9, T18, T19, T21, X29, X36) ------------------------------------------

WEIGHTS = {"war": 0.7, "politics": 0.65, "economy": 0.6, "society": 0.45, "technology": 0.5, "culture": 0.4, "sport": 0.3}
LOCAL = ("sport", "society", "culture")


@query(f"""WITH chronic AS (SELECT story_id FROM {EVENTS} WHERE story_id IS NOT NULL GROUP BY story_id HAVING count(*) >= 8 AND max(first_seen_at) - min(first_seen_at) >= INTERVAL 4 DAY),
x AS (SELECT e.id, coalesce(CASE lower(rubric) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} END, 0.5) AS w, regexp_matches(lower(coalesce(title, '')), 'україн|ukrain|київ|kyiv') AS ua, coalesce(lower(rubric) IN ('sport', 'society', 'culture'), true) OR lower(rubric) NOT IN ('war', 'politics', 'economy', 'technology') AS lo,
 greatest(coalesce(independent_source_count, 0) - 1, 0) AS extra, c.story_id IS NOT NULL AS chronic FROM (SELECT DISTINCT id, story_id, title, rubric, independent_source_count FROM news_events) e LEFT JOIN chronic c ON c.story_id = e.story_id)
SELECT id, round(greatest(0, least(1, w + CASE WHEN ua THEN 0.15 WHEN lo THEN -0.25 ELSE 0 END + least(extra * 0.05, 0.2) - CASE WHEN chronic THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS score,
 array_to_string(list_filter([CASE WHEN ua THEN 'ua_relevant' WHEN lo THEN 'foreign_locality_sensitive' END, CASE WHEN extra > 0 THEN 'corroborated' END, CASE WHEN chronic THEN 'routine_theme' END], lambda y: y IS NOT NULL), ',') AS reasons FROM x""")
def x10_significance(spark, d):
    """Weight of the rubric, plus or minus place, corroboration and routine, within 0 and 1, and why."""
    e = A.news_events(spark, d, "story_id", "title", "rubric", "independent_source_count", "first_seen_at")
    told = e.where("story_id is not null").groupBy("story_id").agg(F.count("*").alias("n"), (F.max("first_seen_at") - F.min("first_seen_at")).alias("span"))
    routine = told.where(F.expr("n >= 8 and span >= interval 4 days")).select("story_id", F.lit(True).alias("chronic"))
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    r = F.lower("rubric")
    w = F.coalesce(F.try_element_at(weight, F.coalesce(r, F.lit(""))), F.lit(0.5))
    ua = text.any_match(F.lower(F.coalesce("title", F.lit(""))), ["україн|ukrain", "київ|kyiv"])
    local = F.coalesce(r.isin(*LOCAL) | ~r.isin(*WEIGHTS), F.lit(True))
    extra = F.greatest(F.coalesce("independent_source_count", F.lit(0)) - 1, F.lit(0))
    again = F.coalesce("chronic", F.lit(False))
    score = w + F.when(ua, 0.15).when(local, -0.25).otherwise(0.0) + F.least(extra * 0.05, F.lit(0.2)) - F.when(again, 0.15).otherwise(0.0)
    why = F.array_compact(F.array(F.when(ua, "ua_relevant").when(local, "foreign_locality_sensitive"), F.when(extra > 0, "corroborated"), F.when(again, "routine_theme")))
    return e.join(routine, "story_id", "left").select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), F.array_join(why, ",").alias("reasons"))


@query(f"SELECT id, CASE WHEN update_type IN ('new_fact', 'refutation') OR (update_type = 'consequence' AND coalesce(significance, 0) >= 0.5) THEN 'post' ELSE 'summary_update' END AS route FROM {EVENTS}")
def t18_routes(spark, d):
    """Whether an event is posted or only updates its story."""
    return A.news_events(spark, d, "update_type", "significance").select("id", parsers.route_update("update_type", F.coalesce("significance", F.lit(0.0)) >= 0.5).alias("route"))


@query(f"SELECT id, CASE WHEN lower(update_type) = 'refutation' THEN 'must' ELSE 'rank' END AS part FROM {EVENTS} WHERE status IN ('reported', 'confirmed', 'rumor') AND curated IS NULL AND duplicate_of IS NULL AND significance >= 0.3 ORDER BY significance DESC, id LIMIT 50")
def t19_curation(spark, d):
    """The candidates of a tick, the most significant first; refutations go out in any case."""
    e = A.news_events(spark, d, "update_type", "status", "curated", "duplicate_of", "significance").where("status in ('reported', 'confirmed', 'rumor') and curated is null and duplicate_of is null and significance >= 0.3")
    return e.orderBy(F.desc("significance"), "id").limit(50).select("id", F.when(F.lower("update_type") == "refutation", "must").otherwise("rank").alias("part"))


@query(f"SELECT l.item_id, 'filtered_out' AS status FROM {LINKS} l JOIN {EVENTS} e ON e.id = l.event_id WHERE e.rubric IS NULL AND l.item_id NOT IN (SELECT l2.item_id FROM {LINKS} l2 JOIN {EVENTS} e2 ON e2.id = l2.event_id WHERE e2.rubric IS NOT NULL) GROUP BY l.item_id")
def t09_retired(spark, d):
    """Posts of events that are none (no rubric here), unless a real event has them too."""
    e = A.news_events(spark, d, "rubric").withColumnRenamed("id", "event_id")
    own = L.links(spark, d).join(e, "event_id")
    gone, kept = own.where("rubric is null").select("item_id").distinct(), own.where("rubric is not null")
    return R.without(gone, kept, ["item_id"]).withColumn("status", F.lit("filtered_out"))


@query(f"SELECT id, CAST(floor(epoch({NOW} - first_seen_at) / 3600) AS BIGINT) AS age_hours FROM {EVENTS} WHERE first_seen_at IS NOT NULL")
def x29_age_hours(spark, d):
    e = A.news_events(spark, d, "first_seen_at").where("first_seen_at is not null")
    return e.select("id", F.floor((F.unix_micros(F.expr(NOW)) - F.unix_micros("first_seen_at")) / F.lit(3.6e9)).alias("age_hours"))


# ---- facts (T22, T23, L9, X31) ----------------------------------------------------------------------


@query("SELECT event_id, source_id, fact FROM (SELECT DISTINCT id AS event_id, first_source_id AS source_id, unnest(keywords) AS fact, unnest(range(1, len(keywords) + 1)) AS n FROM news_events WHERE first_source_id IS NOT NULL) WHERE n <= 20 AND trim(fact) <> ''")
def t22_facts_by_source(spark, d):
    """At most twenty facts a source and event, in their order; keywords stand for facts."""
    e = A.news_events(spark, d, "first_source_id", "keywords").where("first_source_id is not null")
    return e.select(F.col("id").alias("event_id"), F.col("first_source_id").alias("source_id"), F.explode(F.slice("keywords", 1, 20)).alias("fact")).where("trim(fact) <> ''")


_FACTS = "(SELECT story_id, fact, count(DISTINCT first_source_id) AS confirmed_by, min(id) AS first_event FROM (SELECT DISTINCT id, story_id, first_source_id, unnest(list_distinct(keywords)) AS fact FROM news_events WHERE story_id IS NOT NULL) WHERE trim(fact) <> '' GROUP BY story_id, fact)"


def _story_facts(spark, d):
    e = A.news_events(spark, d, "story_id", "first_source_id", "keywords").where("story_id is not null")
    each = e.select("id", "story_id", "first_source_id", F.explode(F.array_distinct("keywords")).alias("fact")).where("trim(fact) <> ''")
    return each.groupBy("story_id", "fact").agg(F.countDistinct("first_source_id").alias("confirmed_by"), F.min("id").alias("first_event"))


@query(f"SELECT story_id, fact, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY confirmed_by DESC, first_event, fact) AS rn FROM {_FACTS}) WHERE rn <= 3")
def l09_top_facts(spark, d):
    """The three facts of a story that most sources confirm."""
    return R.top_k(_story_facts(spark, d), ["story_id"], 3, F.desc("confirmed_by"), F.col("first_event"), F.col("fact")).select("story_id", "fact", "rank")


@query(f"""SELECT story_id, '{{"facts":' || to_json(list(struct_pack(text := fact, confirmed_by := confirmed_by) ORDER BY confirmed_by DESC, first_event, fact)) || '}}' AS fact_base FROM {_FACTS} GROUP BY story_id""")
def x31_fact_base(spark, d):
    """A story's facts as JSON."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("confirmed_by")).alias("minus"), "first_event", "fact", "confirmed_by")))
    facts = F.transform(rows, lambda x: F.struct(x["fact"].alias("text"), x["confirmed_by"].alias("confirmed_by")))
    return _story_facts(spark, d).groupBy("story_id").agg(F.to_json(F.struct(facts.alias("facts"))).alias("fact_base"))


@query("""WITH near AS (SELECT q.vec_id AS claim_id, q.label AS event_id, e.vec_id AS item_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
c AS (SELECT vec_id AS claim_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE vec_id % 50 = 0)
SELECT event_id, claim_id, item_id, CAST(rn AS INT) AS place FROM (SELECT near.*, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, item_id) AS rn FROM near) JOIN c USING (claim_id) WHERE rn <= 5 AND n <= 12""")
def t23_claim_evidence(spark, d):
    """At most twelve claims an event (label) and five pieces of evidence a claim."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    q = e.where("vec_id % 50 = 0")
    claims = R.top_k(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("event_id")), ["event_id"], 12, F.col("query_id")).drop("rank")
    near = R.nearest_vectors(q.select("vec_id", "embedding"), e, "vec_id", "embedding", 5)
    return near.join(claims, "query_id").select("event_id", F.col("query_id").alias("claim_id"), F.col("id").alias("item_id"), F.col("rank").alias("place"))


# ---- images (F21, T25) ----------------------------------------------------------------------------------


@query(f"SELECT l.event_id, CASE WHEN bool_or(m.width < 100) THEN 'blocked' ELSE 'clean' END AS decision, count(*) AS checked FROM {LINKS} l JOIN {MEDIA} m ON m.item_id = l.item_id WHERE m.kind = 'image' AND m.storage_key IS NOT NULL GROUP BY l.event_id")
def t25_moderation(spark, d):
    """An event's images are blocked if one is (narrow ones here); events without a checked image have no decision."""
    m = L.media(spark, d).where("kind = 'image' and storage_key is not null").select("item_id", "width")
    g = L.links(spark, d).select("event_id", "item_id").join(m, "item_id").groupBy("event_id")
    return g.agg(F.when(F.bool_or(F.col("width") < 100), "blocked").otherwise("clean").alias("decision"), F.count("*").alias("checked"))


@query(f"SELECT event_id FROM (SELECT l.event_id, bool_or(m.width < 100) AS blocked FROM {LINKS} l JOIN {MEDIA} m ON m.item_id = l.item_id WHERE m.kind = 'image' AND m.storage_key IS NOT NULL GROUP BY l.event_id) WHERE NOT blocked AND event_id IN (SELECT event_id FROM {PUBS})")
def f21_attachable(spark, d):
    """publications whose images were checked and found clean; without a check nothing is attached."""
    clean = t25_moderation(spark, d).where("decision = 'clean'").select("event_id")
    return clean.join(L.publications(spark, d).select("event_id"), "event_id", "left_semi")


# ---- stores and reports (T31, T32, R1, R2, R4, R5, R6, R7, R8, S12, S31, X33, X34) --------------------------


@query(analytics.ORACLES["a02_rubric_demand"].replace("SELECT rubric, round(CASE", "SELECT 'demand' AS key, rubric, round(CASE", 1) if "SELECT rubric, round(CASE" in analytics.ORACLES["a02_rubric_demand"] else "")
def t31_demand_store(spark, d):
    """The index kept as one JSON value under a key, and read back, as the report shows it."""
    rows = analytics.QUERIES["a02_rubric_demand"](spark, d)
    kept = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("rubric", "demand")))).alias("value")).select(F.lit("demand").alias("key"), "value")  # one entry a rubric
    return kept.select("key", F.explode(F.from_json("value", "map<string,double>")).alias("rubric", "demand"))


@query("SELECT lower(trim(action)) AS key, arg_max(mode, struct_pack(a := created_at, b := id)) AS value FROM (SELECT DISTINCT id, action, mode, created_at FROM merge_verdicts) GROUP BY 1")
def t32_settings(spark, d):
    """The last value of each key."""
    v = table(spark, d, "merge_verdicts").select("id", F.lower(F.trim("action")).alias("key"), "mode", "created_at").distinct()
    return v.groupBy("key").agg(F.max_by("mode", F.struct("created_at", "id")).alias("value"))


@query(f"SELECT 'items' AS entity, status, count(*) AS n FROM {ITEMS} GROUP BY status UNION ALL SELECT 'events', status, count(*) FROM {EVENTS} GROUP BY status UNION ALL SELECT 'curated', curated, count(*) FROM {EVENTS} WHERE curated IS NOT NULL GROUP BY curated UNION ALL SELECT 'publications', status, count(*) FROM {PUBS} WHERE status = 'draft' OR published_at >= {NOW} - INTERVAL 30 DAY GROUP BY status")
def r01_stats(spark, d):
    """Posts, events and choices by status, drafts, and what was published lately."""
    count = lambda df, name, c="status": df.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), F.col(c).alias("status"), "n")
    e = A.news_events(spark, d, "status", "curated")
    p = L.publications(spark, d).where(F.expr(f"status = 'draft' or published_at >= {NOW} - interval 30 days"))
    return count(A.items(spark, d, "status"), "items").union(count(e, "events")).union(count(e.where("curated is not null"), "curated", "curated")).union(count(p, "publications"))


@query(f"SELECT id, event_id, left(coalesce(headline, ''), 40) AS headline, strftime(published_at, '%m-%d %H:%M') AS utc FROM {PUBS} WHERE status = 'published' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 10")
def r02_publications(spark, d):
    p = L.publications(spark, d).where("status = 'published'").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(10)
    return p.select("id", "event_id", F.left(F.coalesce("headline", F.lit("")), F.lit(40)).alias("headline"), F.date_format("published_at", "MM-dd HH:mm").alias("utc"))


@query("SELECT count(*) AS total, count(*) FILTER (active) AS active, (SELECT string_agg(name, ' | ' ORDER BY created_at DESC, id) FROM (SELECT * FROM sources WHERE kind = 'telegram' ORDER BY created_at DESC, id LIMIT 15)) AS recent FROM sources WHERE kind = 'telegram'")
def r05_telegram(spark, d):
    """How many channels there are and are active, and the newest fifteen."""
    s = A.sources(spark, d).where("kind = 'telegram'")
    new = s.orderBy(F.desc("created_at"), "id").limit(15).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("at"), "id", "name"))).alias("x"))
    recent = new.select(F.array_join(F.transform("x", lambda r: r["name"]), " | ").alias("recent"), F.lit(1).alias("one"))
    return s.agg(F.count("*").alias("total"), F.count_if("active").alias("active")).withColumn("one", F.lit(1)).join(recent, "one").drop("one")


@query(f"SELECT p.id, p.event_id, v.reason FROM (SELECT * FROM {PUBS} WHERE status = 'review' ORDER BY id DESC LIMIT 15) p LEFT JOIN (SELECT event_id, arg_max(lower(trim(action)) || ':' || mode, id) AS reason FROM (SELECT DISTINCT id, event_id, action, mode FROM merge_verdicts) GROUP BY event_id) v ON v.event_id = p.event_id")
def r06_review(spark, d):
    """Publications held for review, with the last journalled reason."""
    p = L.publications(spark, d).where("status = 'review'").orderBy(F.desc("id")).limit(15).select("id", "event_id")
    v = table(spark, d, "merge_verdicts").select("id", "event_id", F.concat_ws(":", F.lower(F.trim("action")), "mode").alias("reason")).join(p.select("event_id"), "event_id", "left_semi").distinct()
    return p.join(v.groupBy("event_id").agg(F.max_by("reason", "id").alias("reason")), "event_id", "left").select("id", "event_id", "reason")


@query(f"SELECT s.name, s.tier, max(a.subscribers) AS subscribers FROM sources s JOIN {AUDIENCE} a ON a.source_id = s.id WHERE s.kind = 'telegram' GROUP BY s.name, s.tier")
def r07_sources(spark, d):
    """The largest audience ever seen, per channel."""
    s = A.sources(spark, d).where("kind = 'telegram'").select(F.col("id").alias("source_id"), "name", "tier")
    return L.audience(spark, d).groupBy("source_id").agg(F.max("subscribers").alias("n")).join(s, "source_id").groupBy("name", "tier").agg(F.max("n").alias("subscribers"))


_POLLS = "(SELECT * FROM (SELECT item_id, id, reactions, forwards, row_number() OVER (PARTITION BY item_id ORDER BY measured_at DESC, id DESC) AS rn FROM (SELECT DISTINCT id, item_id, measured_at, reactions, forwards FROM item_metrics)) WHERE rn = 1)"


@query(f"""SELECT p.item_id, s.name, round((coalesce(list_sum(map_values(p.reactions)), 0) + 2 * coalesce(p.forwards, 0)) / a.subscribers, 6) AS rate FROM {_POLLS} p JOIN {ITEMS} i ON i.id = p.item_id JOIN sources s ON s.id = i.source_id
JOIN (SELECT source_id, arg_max(subscribers, day) AS subscribers FROM {AUDIENCE} WHERE subscribers > 0 GROUP BY source_id) a ON a.source_id = i.source_id""")
def r08_engagement(spark, d):
    """The latest poll of each post against its channel's audience."""
    m = table(spark, d, "item_metrics").select("id", "item_id", "measured_at", "reactions", "forwards").dropDuplicates(["id"])
    last = m.groupBy("item_id").agg(F.max_by(F.struct("reactions", "forwards"), F.struct("measured_at", "id")).alias("p")).select("item_id", "p.*")
    i = A.items(spark, d, "source_id").withColumnRenamed("id", "item_id")
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "name")
    a = L.audience(spark, d).where("subscribers > 0").groupBy("source_id").agg(F.max_by("subscribers", "day").alias("subscribers"))
    rate = scores.engagement_rate("reactions", "forwards", "subscribers")
    return last.join(i, "item_id").join(s, "source_id").join(a, "source_id").select("item_id", "name", F.round(rate, 6).alias("rate"))


@query(f"SELECT CAST(id AS BIGINT) AS id, 'source' AS entity FROM sources WHERE kind = 'telegram' AND active UNION ALL SELECT * FROM (SELECT i.id, 'item' FROM {ITEMS} i JOIN sources s ON s.id = i.source_id WHERE s.kind = 'telegram' AND i.published_at >= {NOW} - INTERVAL 30 DAY ORDER BY i.id DESC LIMIT 300)")
def s31_to_poll(spark, d):
    """What a polling round asks for: the active channels and the newest posts."""
    s = A.sources(spark, d).where("kind = 'telegram'").select("id", "active")
    i = A.items(spark, d, "source_id", "published_at").where(F.expr(f"published_at >= {NOW} - interval 30 days")).join(s.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    own = s.where("active").select(F.col("id").cast("bigint").alias("id"), F.lit("source").alias("entity"))
    return own.union(i.orderBy(F.desc("id")).limit(300).select("id", F.lit("item").alias("entity")))


@query("SELECT id, CASE WHEN kind NOT IN ('telegram', 'rss', 'site', 'x', 'threads') THEN 'kind' WHEN origin NOT IN ('ua', 'world') THEN 'origin' WHEN tier NOT IN ('official', 'media', 'aggregator', 'leak', 'anonymous') THEN 'tier' WHEN coalesce(poll_interval, 0) <= 0 THEN 'poll_interval' WHEN n > 1 THEN 'repeated' ELSE 'fine' END AS problem FROM (SELECT *, count(*) OVER (PARTITION BY kind, lower(trim(handle_or_url))) AS n FROM sources)")
def s12_config_problems(spark, d):
    """The first thing wrong with each configured source."""
    n = F.count("*").over(Window.partitionBy("kind", F.lower(F.trim("handle_or_url"))))
    s = A.sources(spark, d).withColumn("n", n)
    problem = (
        F.when(~F.col("kind").isin("telegram", "rss", "site", "x", "threads"), "kind").when(~F.col("origin").isin("ua", "world"), "origin").when(~F.col("tier").isin("official", "media", "aggregator", "leak", "anonymous"), "tier")
        .when(F.coalesce("poll_interval", F.lit(0)) <= 0, "poll_interval").when(F.col("n") > 1, "repeated").otherwise("fine")
    )
    return s.select("id", problem.alias("problem"))


@query(f"SELECT id, '⚠ ' || upper(coalesce(risk_level, '?')) || CASE WHEN is_rumor THEN ' (rumor)' ELSE '' END || ': ' || left(coalesce(title, ''), 80) AS notice FROM {EVENTS} WHERE risk_level = 'critical' OR is_rumor")
def x33_notices(spark, d):
    """Notices for the supervisor, of critical events and rumours only."""
    e = A.news_events(spark, d, "risk_level", "is_rumor", "title").where("risk_level = 'critical' or is_rumor")
    line = F.concat(F.lit("⚠ "), F.upper(F.coalesce("risk_level", F.lit("?"))), F.when(F.col("is_rumor"), " (rumor)").otherwise(""), F.lit(": "), F.left(F.coalesce("title", F.lit("")), F.lit(80)))
    return e.select("id", line.alias("notice"))


@query("SELECT parent_id, string_agg('[' || id || '] ' || trim(coalesce(label, '')), chr(10) ORDER BY id) AS prompt FROM (SELECT DISTINCT id, parent_id, label FROM taxonomy_nodes WHERE parent_id IS NOT NULL) GROUP BY parent_id HAVING count(*) >= 2")
def x34_sibling_prompts(spark, d):
    """The siblings under each node as lines of a prompt."""
    n = table(spark, d, "taxonomy_nodes").where("parent_id is not null").select("id", "parent_id", "label").distinct()
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.trim(F.coalesce("label", F.lit(""))))
    rows = n.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("x")).where(F.size("x") >= 2)
    return rows.select("parent_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("prompt"))


@query(f"SELECT story_id, max(id) + 1 AS next_id, count(*) + 1 AS next_version, arg_max(left(title, 80), struct_pack(a := first_seen_at, b := id)) AS latest FROM {EVENTS} WHERE story_id IS NOT NULL AND first_seen_at IS NOT NULL AND title IS NOT NULL GROUP BY story_id")
def w06_next_versions(spark, d):
    """A story's next version and its latest title."""
    e = A.news_events(spark, d, "story_id", "first_seen_at", "title").where("story_id is not null and first_seen_at is not null and title is not null")
    return e.groupBy("story_id").agg((F.max("id") + 1).alias("next_id"), (F.count("*") + 1).alias("next_version"), F.max_by(F.left("title", F.lit(80)), F.struct("first_seen_at", "id")).alias("latest"))


# ---- case tables (S10, F25, X24, X35, X37, U4) -----------------------------------------------------------------


def media_of_message(photo, video_size, document_type, document_size):
    """The image and video records (kind, size_bytes) of a message: a photo, and a video or else a document that is one."""
    image = F.when(F.coalesce(photo, F.lit(False)), F.struct(F.lit("image").alias("kind"), F.lit(None).cast("bigint").alias("size_bytes")))
    as_video = F.when(video_size.isNotNull(), video_size).when(F.lower(document_type).startswith("video"), F.coalesce(document_size, F.lit(-1)))
    video = F.when(as_video.isNotNull(), F.struct(F.lit("video").alias("kind"), F.nullif(as_video, F.lit(-1)).alias("size_bytes")))
    return F.array_compact(F.array(image, video))


case_table(
    "s10_media_of_message", "photo boolean, video bigint, kind string, size bigint",
    [((True, None, None, None), '[{"kind":"image"}]'), ((True, 5, None, None), '[{"kind":"image"},{"kind":"video","size_bytes":5}]'), ((None, None, "video/mp4", 9), '[{"kind":"video","size_bytes":9}]'), ((False, None, "application/pdf", 9), "[]"), ((None, None, "video/mp4", None), '[{"kind":"video"}]'), ((None, 4, "video/mp4", 9), '[{"kind":"video","size_bytes":4}]')],
    lambda: media_of_message(F.col("photo"), F.col("video"), F.col("kind"), F.col("size")),
)
case_table(
    "x35_moderation_source", "url string, data binary",
    [(("http://a", bytearray(b"\x89PNG\r\n\x1a\n")), "http://a"), ((None, bytearray(b"\x89PNG\r\n\x1a\n")), "data:image/png;base64,iVBORw0KGgo="), (("", bytearray(b"GIF89a")), "data:image/gif;base64,R0lGODlh"), ((None, None), None)],
    lambda: F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("data:"), text.image_mime("data"), F.lit(";base64,"), F.base64("data"))),
)
case_table(
    "f25_authorised", "chat bigint, who bigint",
    [((7, 1), "true"), ((8, 3), "false"), ((7, 9), "false"), ((None, 1), "false"), ((7, None), "false")],
    lambda: F.coalesce((F.col("chat") == 7) & (F.col("who") == 1), F.lit(False)),
)
case_table(
    "x37_details", "cosine double, distance int, same boolean",
    [((0.123456, 4, True), '{"cosine":0.1235,"simhash_distance":4,"exact_content_hash":true}'), ((None, None, False), '{"exact_content_hash":false}')],
    lambda: F.struct(F.round("cosine", 4).alias("cosine"), F.col("distance").alias("simhash_distance"), F.col("same").alias("exact_content_hash")),
)
case_table("u04_worthy_updates", "x int", [((1,), '["new_fact","refutation","consequence"]')], lambda: F.array(*[F.lit(u) for u in parsers.UPDATES if u not in parsers.SUMMARY_ONLY]))
