"""SQL for the core's queries."""

from tidewire.plans import analytics, cases, desk, editorial

_ROLLING = """
WITH once AS (SELECT item_id, measured_at, min(struct_pack(id := id, v := greatest(coalesce(views, 0), 0), f := greatest(coalesce(forwards, 0), 0))) AS p
  FROM item_metrics WHERE item_id IS NOT NULL AND measured_at IS NOT NULL GROUP BY item_id, measured_at),
daily AS (SELECT item_id, CAST(measured_at AS DATE) AS day, sum(p.v) AS v, sum(p.f) AS f FROM once GROUP BY 1, 2),
spans AS (SELECT item_id, min(day) AS first, max(day) AS last FROM daily GROUP BY item_id),
calendar AS (SELECT item_id, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
filled AS (SELECT c.item_id, c.day, coalesce(d.v, 0) AS v, coalesce(d.f, 0) AS f FROM calendar c LEFT JOIN daily d ON d.item_id = c.item_id AND d.day = c.day),
rolled AS (SELECT item_id, day, CAST(sum(v) OVER a AS BIGINT) AS views_7d, CAST(sum(v) OVER b AS BIGINT) AS views_30d, CAST(sum(f) OVER a AS BIGINT) AS forwards_7d,
  CAST(sum(f) OVER b AS BIGINT) AS forwards_30d, count(*) OVER a AS n7, count(*) OVER b AS n30
  FROM filled WINDOW a AS (PARTITION BY item_id ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY item_id ORDER BY day ROWS 29 PRECEDING))
"""

_TREE = """
WITH RECURSIVE own AS (SELECT id, min(parent_id) AS parent_id, min(label) AS label FROM taxonomy_nodes WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT o.id, p.id AS parent, o.label FROM own o LEFT JOIN own p ON p.id = o.parent_id),
down AS (SELECT id, id AS root_id, 0 AS node_depth, label AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, d.root_id, d.node_depth + 1, d.path || ' / ' || l.label FROM links l JOIN down d ON l.parent = d.id),
up(id, anc, distance) AS (SELECT id, parent, 1 FROM links WHERE parent IS NOT NULL AND id IN (SELECT id FROM down)
  UNION ALL SELECT u.id, l.parent, u.distance + 1 FROM up u JOIN links l ON l.id = u.anc WHERE l.parent IS NOT NULL),
rest AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT id FROM down)),
walk(id, stop) AS (SELECT id, parent FROM rest UNION SELECT w.id, r.parent FROM walk w JOIN rest r ON r.id = w.stop),
rings AS (SELECT id FROM walk WHERE id = stop),
looped AS (SELECT w.id, min(w.stop) AS root_id FROM walk w JOIN rings r ON r.id = w.stop GROUP BY w.id)
"""

ORACLES = analytics.ORACLES | {name: sql for name, (_, sql) in (editorial.BOTH | desk.BOTH | cases.BOTH).items() if sql} | {
    "p2_found": _TREE + "SELECT id AS node_id, root_id, node_depth FROM down UNION ALL SELECT id, root_id, -1 FROM looped",
    "p2_paths": _TREE
    + """SELECT d.id AS node_id, d.root_id, d.node_depth, coalesce(n.n, 0) AS descendants, d.path FROM down d
LEFT JOIN (SELECT anc, count(*) AS n FROM up GROUP BY anc) n ON n.anc = d.id""",
    "p2_descendants": _TREE + "SELECT anc AS ancestor_id, id AS node_id, distance FROM up",
    "p2_cycles": _TREE + "SELECT DISTINCT root_id AS cycle_id FROM looped",
    "p7_found": _ROLLING
    + """SELECT item_id, strftime(day, '%Y-%m-%d') AS on_day, 'views' AS metric_name FROM rolled WHERE 2 * views_7d * n30 > 5 * views_30d * n7
UNION ALL SELECT item_id, strftime(day, '%Y-%m-%d'), 'forwards' FROM rolled WHERE 2 * forwards_7d * n30 > 5 * forwards_30d * n7""",
    "p7_rolling": _ROLLING
    + """SELECT item_id, strftime(day, '%Y-%m-%d') AS day, views_7d, views_30d, forwards_7d, forwards_30d, round(views_7d / n7, 6) AS views_avg_7d,
round(views_30d / n30, 6) AS views_avg_30d, round(forwards_7d / n7, 6) AS forwards_avg_7d, round(forwards_30d / n30, 6) AS forwards_avg_30d FROM rolled""",
}
