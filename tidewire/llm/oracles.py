"""SQL for the queries of the operators for training data, where SQL can say it."""

_RECORDS = r"""
WITH RECURSIVE matches AS (
  SELECT DISTINCT event_id AS a, canonical_event_id AS b FROM merge_verdicts
  WHERE lower(trim(action)) IN ('duplicate', 'ingest_duplicate') AND canonical_event_id IS NOT NULL
    AND canonical_event_id <> 0 AND canonical_event_id <> event_id AND event_id IS NOT NULL),
links AS (SELECT a, b FROM matches UNION SELECT b, a FROM matches),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grouped AS (SELECT a AS event_id, least(a, min(b)) AS group_id FROM reach GROUP BY a)
"""

_SHINGLES = r"""
tok AS (SELECT id, since, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[0-9a-zA-Zа-яА-ЯіІїЇєЄґҐ'']+') AS t FROM once),
sh AS (SELECT DISTINCT id, since, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS s FROM tok WHERE len(t) >= 3),
sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id)
"""
_ITEMS = "WITH RECURSIVE once AS (SELECT DISTINCT id, title, text, 0 AS since FROM news_items)," + _SHINGLES
_CLASSES = """, classes AS (SELECT md5(string_agg(s, '|' ORDER BY s)) AS c, id FROM sh GROUP BY id), named AS (SELECT id, min(id) OVER (PARTITION BY c) AS class_id FROM classes),
own AS (SELECT sh.* FROM sh WHERE id IN (SELECT class_id FROM named)),
alike AS (SELECT x AS a, y AS b FROM (SELECT p.id AS x, q.id AS y, count(*) AS n FROM own p JOIN own q ON p.s = q.s AND p.id < q.id GROUP BY 1, 2) JOIN sizes u ON u.id = x JOIN sizes v ON v.id = y WHERE 2 * n.n >= u.n + v.n - n.n)""".replace("n.n >= u.n + v.n - n.n", "k >= u.n + v.n - k").replace("count(*) AS n FROM own", "count(*) AS k FROM own")
_GROUPS = """, links AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""

ORACLES = {
    "p1_found": _RECORDS + "SELECT event_id, group_id FROM grouped",
    "p1_groups": _RECORDS
    + """SELECT g.event_id, g.group_id, count(*) OVER (PARTITION BY g.group_id) AS members, e.id IS NOT NULL AS known
FROM grouped g LEFT JOIN (SELECT DISTINCT id FROM news_events) e ON e.id = g.event_id""",
    "p5_found": r"""
WITH once AS (SELECT DISTINCT id, source_id, text FROM news_items WHERE id IS NOT NULL AND source_id IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT DISTINCT id, source_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS line FROM once),
kept AS (SELECT * FROM lines WHERE line <> ''),
sizes AS (SELECT source_id, count(DISTINCT id) AS n FROM kept GROUP BY source_id)
SELECT k.source_id, k.line FROM kept k JOIN sizes s ON s.source_id = k.source_id
GROUP BY k.source_id, k.line, s.n HAVING count(DISTINCT k.id) >= 5 AND count(DISTINCT k.id) * 20 >= s.n""",
    "p3_found": "WITH once AS (SELECT DISTINCT id, title, text, 0 AS since FROM news_items UNION ALL SELECT DISTINCT id, title, text, batch_id FROM raw_items WHERE batch_id IS NOT NULL)," + _SHINGLES
    + """SELECT old_id, new_id FROM (SELECT a.id AS old_id, b.id AS new_id, count(*) AS k FROM sh b JOIN sh a ON a.s = b.s AND a.since < b.since AND a.id < b.id GROUP BY 1, 2) JOIN sizes u ON u.id = old_id JOIN sizes v ON v.id = new_id WHERE 2 * k >= u.n + v.n - k""",
    "p4_found": _ITEMS
    + """SELECT item_a, item_b FROM (SELECT a.id AS item_a, b.id AS item_b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2) JOIN sizes u ON u.id = item_a JOIN sizes v ON v.id = item_b WHERE 2 * k >= u.n + v.n - k""",
    "p4_groups": _ITEMS + _CLASSES + _GROUPS
    + """SELECT o.id AS item_id, coalesce(n.class_id, o.id) AS class_id, coalesce(l.links, 0) AS links, least(coalesce(n.class_id, o.id), coalesce(r.low, o.id)) AS group_id FROM (SELECT DISTINCT id FROM once WHERE id IS NOT NULL) o LEFT JOIN named n ON n.id = o.id
LEFT JOIN (SELECT a, count(*) AS links FROM links GROUP BY a) l ON l.a = n.class_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = n.class_id""",
    "p6_found": """WITH v AS (SELECT id, any_value(CAST(centroid AS DOUBLE[])) AS c FROM stories WHERE len(centroid) = 64 AND list_sum(list_transform(centroid, lambda x: abs(x))) > 0 GROUP BY id),
near AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.c, b.c) AS cosine FROM v a JOIN v b ON a.id <> b.id), best AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS rn FROM near)
SELECT DISTINCT least(x, y) AS story_a, greatest(x, y) AS story_b FROM best WHERE rn <= 10 AND cosine >= 0.9""",
}
