"""Queries of the analytics operators, each with the SQL it must equal: NAME -> (function, SQL).

Names start with the operator's id in the inventory. SQL patterns use what both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import scores, text
from tidewire.operators import relational as R
from tidewire.plans import adapters as A
from tidewire.session import table

BOTH: dict = {}
AS_OF = "TIMESTAMP '2025-05-01 00:00:00'"
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NORM = {c: f"lower(trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g')))" for c in ("title", "text")}
ITEMS = "(SELECT DISTINCT * EXCLUDE (raw_payload) FROM news_items)"
EVENTS = "(SELECT DISTINCT id, story_id, title, status, risk_level, rubric, region, first_seen_at, first_source_id, independent_source_count, update_type, side, is_rumor, significance, curated, duplicate_of, topic_leaf_id, created_at, updated_at FROM news_events)"
METRICS = """(SELECT event_id AS id, user_id AS item_id, ts AS measured_at, event_type AS rubric, CAST(json_extract_string(props, '$.k') AS INT) AS likes,
 CAST(floor(value) AS INT) AS forwards, user_id % 10 + 1 AS source_id FROM events)"""
SUBS = "(SELECT s_suppkey AS source_id, s_name AS name, ['official','media','aggregator','leak','anonymous'][s_suppkey % 5 + 1] AS tier, CAST(floor(abs(s_acctbal)) AS INT) AS subscribers FROM supplier)"
JOURNAL = "(SELECT l_suppkey AS source_id, l_orderkey AS event_id, l_linenumber AS line, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'first' WHEN 'NF' THEN 'confirmed' WHEN 'NO' THEN 'copy' WHEN 'RF' THEN 'refuted' ELSE 'other' END AS kind, l_shipdate AS at_ FROM lineitem)"
TIERS = {"official": 1.0, "media": 0.8, "aggregator": 0.5, "leak": 0.4, "anonymous": 0.3}
KINDS = {"first": 2.0, "confirmed": 3.0, "copy": -0.5, "refuted": -4.0}
NOISE = {"advert": "знижк|реклам|промокод|безкоштовн", "digest": "дайджест|підсумк", "weather": "погод|температур|негод"}
ALERT, NO_ALERT = ["тривог", "безпілотник", "ракет"], ["відбій", "спростува"]


def query(sql: str):
    def add(f):
        BOTH[f.__name__] = (f, sql)
        return f

    return add


def _case(column: str, values: dict[str, float], default: str = "0") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _map(column, values: dict):
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[column]


# ---- text and identity -------------------------------------------------------------------


@query(f"SELECT id, {NORM['title']} AS title, {NORM['text']} AS text FROM {ITEMS}")
def x01_normalize_text(spark, d):
    i = A.items(spark, d, "title", "text")
    return i.select("id", text.normalize_text("title").alias("title"), text.normalize_text("text").alias("text"))


@query(f"SELECT id, sha256({NORM['title']} || chr(10) || {NORM['text']}) AS hash FROM {ITEMS}")
def x02_content_hash(spark, d):
    return A.derived(spark, d, text.content_hash("title", "text").alias("hash"))


@query(f"SELECT id, simhash FROM {ITEMS} WHERE simhash IS NOT NULL")
def x03_simhash(spark, d):
    """The signature of title and text, for all posts whose collector stored one: it must be the stored one."""
    i = A.derived(spark, d, text.simhash("title", "text").alias("simhash"), F.col("simhash").alias("stored"))
    return i.where("stored is not null").select("id", "simhash")


@query(f"SELECT i.id, bit_count(xor(i.simhash, f.h)) AS distance FROM {ITEMS} i JOIN (SELECT source_id, arg_min(simhash, id) AS h FROM {ITEMS} WHERE simhash IS NOT NULL GROUP BY source_id) f ON f.source_id = i.source_id WHERE i.simhash IS NOT NULL")
def x04_hamming(spark, d):
    """Each post against its source's first one."""
    i = A.items(spark, d, "source_id", "simhash").where("simhash is not null")
    first = i.groupBy("source_id").agg(F.min_by("simhash", "id").alias("first"))
    return i.join(first, "source_id").select("id", text.hamming("simhash", "first").alias("distance"))


@query("SELECT a.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 0), 4) AS cosine FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) b ON b.label = a.label")
def x06_cosine(spark, d):
    """Each vector against the first of its label."""
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return v.join(first, "label").select("vec_id", F.round(scores.cosine("embedding", "first"), 4).alias("cosine"))


@query("SELECT id, CASE WHEN regexp_full_match(left(content_hash, 16), '[0-9a-fA-F]{1,16}') THEN ltrim(upper(left(content_hash, 16)), '0') END AS number FROM (SELECT DISTINCT id, content_hash FROM news_items)")
def x16_phash_number(spark, d):
    """All sixteen digits, shown in hexadecimal again."""
    return A.derived(spark, d, F.ltrim(F.hex(text.phash_number(F.left("content_hash", F.lit(16)))), F.lit("0")).alias("number"))


@query(f"""SELECT t AS token, count(*) AS n, count(DISTINCT id) AS items FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{text.TOKEN.replace("'", "''")}')) AS t FROM {ITEMS}) GROUP BY t""")
def x05_tokens(spark, d):
    # all tokens and each post's different ones, side by side: two sums, and no post's id is shuffled with its tokens
    i = A.items(spark, d, "text").select(text.tokens("text").alias("t"))
    all_ = i.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("items"))
    each = i.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("items"))
    return all_.unionByName(each).groupBy("token").agg(F.sum("n").alias("n"), F.sum("items").alias("items"))


@query(f"SELECT id, coalesce(nullif(left(regexp_replace(coalesce(text, ''), '^{WS}|{WS}$', '', 'g'), 8000), ''), ' ') AS clipped FROM {ITEMS}")
def x07_clip_for_embedding(spark, d):
    return A.items(spark, d, "text").select("id", text.clip_for_embedding("text").alias("clipped"))


@query(f"""SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[^0-9a-zа-яіїєґ]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'story') AS slug FROM {ITEMS}""")
def x08_slugify(spark, d):
    return A.items(spark, d, "title").select("id", text.slugify("title").alias("slug"))


@query("""SELECT id, array_to_string(list_filter(list_transform((keywords)[1:5], lambda x: lower(trim(x))), lambda x: x <> ''), '/') AS path FROM (SELECT DISTINCT id, keywords FROM news_events)""")
def x09_normalize_path(spark, d):
    e = A.news_events(spark, d, "keywords")
    return e.select("id", F.when(F.col("keywords").isNotNull(), F.array_join(text.normalize_path("keywords"), "/")).alias("path"))


@query(f"SELECT id, nullif(lower(trim(forwarded_from)), '') AS key FROM {ITEMS}")
def x28_keys(spark, d):
    return A.items(spark, d, "forwarded_from").select("id", text.key_of("forwarded_from").alias("key"))


@query(f"""SELECT id, left(h, 2) || '/' || h AS key FROM (SELECT id, sha256(id || ':' || source_id || ':' || coalesce(url, '')) AS h FROM {ITEMS})""")
def x17_media_key(spark, d):
    return A.items(spark, d, "source_id", "url").select("id", text.media_key("id", "source_id", "url").alias("key"))


@query(f"""SELECT id, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title FROM {ITEMS} WHERE title IS NOT NULL""")
def x22_escape_html(spark, d):
    return A.items(spark, d, "title").where("title is not null").select("id", text.escape_html("title").alias("title"))


@query(f"""SELECT id, 'Post ' || id || ': ' || coalesce(title, '') || ' {{left}}' AS prompt FROM {ITEMS}""")
def x25_fill_prompt(spark, d):
    return A.items(spark, d, "title").select("id", text.fill_prompt(F.lit("Post {id}: {title} {left}"), {"id": "id", "title": "title"}).alias("prompt"))


@query("""SELECT grouped_id, min(id) AS id, count(*) AS parts, arg_min(text, id) FILTER (WHERE trim(coalesce(text, '')) <> '') AS caption FROM (SELECT DISTINCT id, grouped_id, text FROM news_items) WHERE grouped_id IS NOT NULL GROUP BY grouped_id""")
def x26_merge_album(spark, d):
    i = A.items(spark, d, "grouped_id", "text").where("grouped_id is not null")
    caption = F.min_by("text", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("id")))
    return i.groupBy("grouped_id").agg(F.min("id").alias("id"), F.count("*").alias("parts"), caption.alias("caption"))


def x30_split_text(spark, d):
    i = table(spark, d, "documents").select("doc_id", F.posexplode(text.chunked("text")).alias("part", "piece"))
    return i.select("doc_id", "part", F.length("piece").alias("n"))


BOTH["x30_split_text"] = (x30_split_text, None)


@query(f"""SELECT id, nullif(regexp_replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&nbsp;', chr(160)), '&laquo;', '«'), '&raquo;', '»'), '^{WS}|{WS}$', '', 'g'), '') AS bare FROM {ITEMS}""")
def s05_strip_html(spark, d):
    """Entities are resolved in general; the SQL knows those of the test tables."""
    return A.derived(spark, d, text.strip_html("text").alias("bare"))


@query(f"SELECT id, coalesce(nullif(external_id, ''), nullif(url, ''), CAST(id AS VARCHAR)) AS key FROM {ITEMS}")
def s02_external_id(spark, d):
    return A.items(spark, d, "external_id", "url").select("id", text.first_nonempty("external_id", "url", F.col("id").cast("string")).alias("key"))


@query(f"SELECT id FROM {ITEMS} WHERE published_at IS NULL OR published_at >= {AS_OF} - INTERVAL 240 HOUR")
def s06_recent(spark, d):
    return A.items(spark, d, "published_at").where(text.is_recent("published_at", F.expr(AS_OF), 240)).select("id")


@query(f"SELECT i.id FROM {ITEMS} i JOIN sources s ON s.id = i.source_id WHERE s.origin <> 'world' OR regexp_matches(coalesce(i.title, '') || chr(10) || coalesce(i.text, ''), '(?i)ukrain|україн|kyiv|київ')")
def s07_world_relevance(spark, d):
    s = A.sources(spark, d).select(F.col("id").alias("source_id"), "origin")
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    i = A.derived(spark, d, F.col("source_id"), text.any_match(blob, ["ukrain|україн|kyiv|київ"], ignorecase=True).alias("ours"))
    return i.join(s, "source_id").where((F.col("origin") != "world") | F.col("ours")).select("id")


@query(f"SELECT source_id, coalesce(max(TRY_CAST(external_id AS BIGINT)), 0) AS cursor FROM {ITEMS} GROUP BY source_id")
def s11_backfill_cursor(spark, d):
    i = A.items(spark, d, "source_id", "external_id")
    return i.groupBy("source_id").agg(F.coalesce(F.max(F.expr("try_cast(external_id as bigint)")), F.lit(0)).alias("cursor"))


@query("""WITH n AS (SELECT DISTINCT source_id AS id, 'seen ' || source_id AS name FROM raw_items) SELECT coalesce(s.id, n.id) AS id, coalesce(n.name, s.name) AS name, s.consecutive_failures FROM sources s FULL JOIN n ON n.id = s.id""")
def s13_sync_sources(spark, d):
    new = table(spark, d, "raw_items").select(F.col("source_id").alias("id")).distinct().withColumn("name", F.format_string("seen %d", "id"))
    return R.upsert(A.sources(spark, d).select("id", "name", "consecutive_failures"), new, ["id"], ["name"])


@query("""SELECT handle FROM (SELECT DISTINCT lower(ltrim(source, '@')) AS handle FROM documents WHERE trim(coalesce(source, '')) <> '') d WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE lower(ltrim(s.handle_or_url, '@')) = d.handle)""")
def s14_new_subscriptions(spark, d):
    handle = lambda c: F.lower(F.regexp_replace(c, "^@+", "")).alias("handle")
    seen = table(spark, d, "documents").where(F.trim(F.coalesce("source", F.lit(""))) != "").select(handle(F.col("source"))).distinct()
    return R.without(seen, A.sources(spark, d).select(handle(F.col("handle_or_url"))), ["handle"])


@query(f"SELECT id, CASE WHEN lower(coalesce(url, '')) LIKE '%t.example%' THEN 'telegram' ELSE 'web' END AS kind, coalesce(nullif(forwarded_from, ''), nullif(url, ''), '-') AS origin FROM {ITEMS}")
def s09_message_origin(spark, d):
    i = A.items(spark, d, "url", "forwarded_from")
    return i.select("id", F.when(F.lower(F.coalesce("url", F.lit(""))).contains("t.example"), "telegram").otherwise("web").alias("kind"), text.first_nonempty("forwarded_from", "url", F.lit("-")).alias("origin"))


@query("SELECT id, item_id FROM item_metrics WHERE NOT (views IS NULL AND forwards IS NULL AND coalesce(len(map_keys(reactions)), 0) = 0) GROUP BY id, item_id")
def s25_nonempty_polls(spark, d):
    m = table(spark, d, "item_metrics")
    empty = F.col("views").isNull() & F.col("forwards").isNull() & (F.coalesce(F.size("reactions"), F.lit(0)) <= 0)
    return m.where(~empty).select("id", "item_id").distinct()


@query("SELECT id, handle_or_url FROM sources WHERE active AND kind = 'rss'")
def s30_active_feeds(spark, d):
    return A.sources(spark, d).where("active and kind = 'rss'").select("id", "handle_or_url")


# ---- predicates --------------------------------------------------------------------------


def _noise_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(b, '{p}') THEN '{n}' END" for n, p in sorted(NOISE.items()))
    return f"SELECT id, array_to_string(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), ',') AS categories FROM (SELECT id, coalesce(title, '') || chr(10) || coalesce(text, '') AS b FROM {ITEMS})"


@query(_noise_sql())
def f01_noise_categories(spark, d):
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return A.derived(spark, d, F.array_join(text.matched_categories(blob, NOISE), ",").alias("categories"))


@query(f"SELECT id FROM {ITEMS} WHERE regexp_matches(coalesce(text, ''), '{'|'.join(ALERT)}') AND NOT regexp_matches(coalesce(text, ''), '{'|'.join(NO_ALERT)}')")
def f02_air_alert(spark, d):
    return A.derived(spark, d, text.any_match("text", ALERT, exclude=NO_ALERT).alias("alert")).where("alert").select("id")


@query("""SELECT id, CASE WHEN regexp_matches(t, 'спростува') THEN 'block' WHEN regexp_matches(t, 'штаб') AND coalesce(side, 'unknown') IN ('ua', 'unknown') THEN 'needs_official' WHEN regexp_matches(t, 'ціна') THEN 'review' END AS action
FROM (SELECT id, side, coalesce(title, '') AS t FROM (SELECT DISTINCT id, side, title FROM news_events))""")
def f05_worst_action(spark, d):
    rules = [("denial", "спростува", "all", "block"), ("army", "штаб", "ua_side", "needs_official"), ("price", "ціна", "all", "review")]
    return A.news_events(spark, d, "title", "side").select("id", text.worst_action(text.stoplist_hits("title", "side", rules)).alias("action"))


@query(f"""SELECT id, 'number' AS category, unnest(regexp_extract_all(coalesce(title, ''), '[0-9]+')) AS span FROM {EVENTS}""")
def f06_spans(spark, d):
    e = A.news_events(spark, d, "title")
    return e.select("id", F.explode(text.found_spans("title", {"number": "[0-9]+"})).alias("hit")).select("id", "hit.category", "hit.span")


@query(f"SELECT id FROM {EVENTS} WHERE rubric IN ('war', 'security', 'incidents') AND regexp_matches(coalesce(title, ''), '(?i)безпілотник|drone|drohne')")
def f08_attacks(spark, d):
    return A.news_events(spark, d, "rubric", "title").where(F.col("rubric").isin("war", "security", "incidents") & text.any_match("title", ["безпілотник|drone|drohne"], ignorecase=True)).select("id")


@query(f"SELECT id FROM {EVENTS} WHERE significance >= 0.5 OR (significance IS NULL AND updated_at < {AS_OF} - INTERVAL 3 MINUTE)")
def f10_significance_ready(spark, d):
    e = A.news_events(spark, d, "significance", "updated_at")
    return e.where(F.expr(f"significance >= 0.5 or (significance is null and updated_at < {AS_OF} - interval 3 minutes)")).select("id")


@query(f"SELECT id FROM {EVENTS} e WHERE first_seen_at < {AS_OF} - INTERVAL 60 DAY OR EXISTS (SELECT 1 FROM merge_verdicts v WHERE v.event_id = e.id AND v.mode <> 'unavailable')")
def f11_dedup_settled(spark, d):
    done = table(spark, d, "merge_verdicts").where("mode <> 'unavailable'").select(F.col("event_id").alias("id"), F.lit(True).alias("done")).distinct()
    return A.news_events(spark, d, "first_seen_at").join(done, "id", "left").where(F.expr(f"done or first_seen_at < {AS_OF} - interval 60 days")).select("id")


@query(f"SELECT id FROM sources WHERE active AND (last_success_at IS NULL OR epoch({AS_OF}) - epoch(last_success_at) >= coalesce(nullif(poll_interval, 0), 300))")
def f14_due_sources(spark, d):
    interval = F.coalesce(F.nullif(F.col("poll_interval"), F.lit(0)), F.lit(300))
    age = F.unix_seconds(F.expr(AS_OF)) - F.unix_micros("last_success_at") / 1e6
    return A.sources(spark, d).where(F.col("active") & (F.col("last_success_at").isNull() | (age >= interval))).select("id")


@query(f"SELECT id FROM {ITEMS} WHERE {NORM['title']} <> '' OR {NORM['text']} <> ''")
def f16_text_eligible(spark, d):
    return A.derived(spark, d, ((text.normalize_text("title") != "") | (text.normalize_text("text") != "")).alias("told")).where("told").select("id")


@query(f"""SELECT id, array_to_string(list_filter([CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' END, CASE WHEN significance < 0.3 THEN 'insignificant' END, CASE WHEN is_rumor THEN 'rumor' END], lambda x: x IS NOT NULL), ',') AS reasons FROM {EVENTS}""")
def f20_gate_reasons(spark, d):
    e = A.news_events(spark, d, "duplicate_of", "significance", "is_rumor")
    why = scores.blocked_reasons(duplicate=F.col("duplicate_of").isNotNull(), insignificant=F.col("significance") < 0.3, rumor=F.col("is_rumor"))
    return e.select("id", F.array_join(why, ",").alias("reasons"))


@query(f"SELECT status, count(*) AS n FROM {EVENTS} WHERE status NOT IN ('new', 'signal', 'confirmed', 'reported') GROUP BY status")
def f26_status_vocabulary(spark, d):
    return A.news_events(spark, d, "status").where(~F.col("status").isin("new", "signal", "confirmed", "reported")).groupBy("status").agg(F.count("*").alias("n"))
