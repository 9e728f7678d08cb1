"""DuckDB statements that give the rows of those queries SQL can express."""

from __future__ import annotations

STEM = r"nullif(trim(regexp_replace(lower(trim(stem)), '\.(jpg|jpeg|png|bmp|tif|tiff)$', '')), '')"


def _spelled(column: str) -> str:
    return f"regexp_replace(lower({column}), '[^a-z0-9]', '', 'g')"


def _missing(column: str) -> str:
    return f"coalesce({_spelled(column)} IN ('', 'unknown', 'none', 'na', 'null', 'tbd'), true)"


_RELATED = f"""
WITH RECURSIVE i AS MATERIALIZED (
  SELECT DISTINCT item_id, {STEM} AS stem_key, nullif(hash, 0) AS h, nullif(lower(trim(split)), '') AS split,
    CASE WHEN NOT {_missing('scene_key')} THEN {_spelled('scene_key')} END AS scene,
    CASE WHEN NOT {_missing('collected_by')} THEN {_spelled('collected_by')} END AS collector
  FROM items),
k AS MATERIALIZED (
  SELECT item_id, 'scene' AS kind, scene AS key FROM i WHERE scene IS NOT NULL
  UNION ALL SELECT item_id, 'collector', collector FROM i WHERE collector IS NOT NULL
  UNION ALL SELECT item_id, 'stem', stem_key FROM i WHERE stem_key IS NOT NULL),
hub AS MATERIALIZED (SELECT kind, key, min(item_id) AS hub FROM k GROUP BY ALL HAVING count(*) > 1),
e AS MATERIALIZED (
  SELECT k.item_id AS a, hub.hub AS b FROM k JOIN hub ON k.kind = hub.kind AND k.key = hub.key
  UNION SELECT x.item_id, y.item_id FROM i x JOIN i y ON bit_count(xor(x.h, y.h)) <= 3),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT item_id, item_id AS other FROM i UNION SELECT r.item_id, e.b FROM r JOIN both_ways e ON e.a = r.other)"""

P1 = f"{_RELATED} SELECT r.item_id FROM r JOIN i ON i.item_id = r.other GROUP BY r.item_id HAVING count(DISTINCT i.split) > 1"

P1_SPLITS = f"""{_RELATED},
g AS (SELECT item_id, min(other) AS group_id FROM r GROUP BY item_id),
z AS (SELECT group_id, count(*) AS size FROM g GROUP BY group_id),
d AS (SELECT group_id, coalesce(sum(size) OVER (ORDER BY md5('42:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2::DOUBLE AS middle, sum(size) OVER () AS total FROM z)
SELECT item_id, group_id, CASE WHEN middle < total * {0.7!r}::DOUBLE THEN 'train' WHEN middle < total * {0.7 + 0.2!r}::DOUBLE THEN 'val' ELSE 'test' END AS new_split FROM g JOIN d USING (group_id)"""

_CATEGORISED = f"""
i AS (SELECT DISTINCT item_id, lower(trim(split)) AS split, lower(trim(dataset)) AS dataset,
    CASE WHEN NOT {_missing('domain')} THEN lower(trim(domain)) END AS domain, classes FROM items),
e AS (SELECT DISTINCT i.item_id, split, dataset, domain, u.c FROM i, unnest(classes) AS u(c) WHERE u.c IN (SELECT class_id FROM class_names)),
f AS (SELECT c, count(*) AS n FROM e GROUP BY c),
r AS (SELECT item_id, split, dataset, domain, e.c, row_number() OVER (PARTITION BY item_id ORDER BY n, e.c) AS k FROM e JOIN f ON e.c = f.c),
p AS (SELECT item_id, r.split, coalesce(r.domain, d.domain) || ':' || c AS category FROM r LEFT JOIN dataset_domains d ON d.dataset = r.dataset WHERE k = 1),
n AS (SELECT split, category, count(*) AS n FROM p GROUP BY ALL)"""

P2 = f"""
WITH {_CATEGORISED}
SELECT t.request_id, t.category FROM sample_targets t LEFT JOIN n ON n.split = t.split AND n.category = t.category
WHERE coalesce(n.n, 0) < round(t.target_share * t.sample_size, 9) OR coalesce(n.n, 0) < t.min_rows"""

P2_REPORT = f"""
WITH {_CATEGORISED},
t AS (SELECT s.*, coalesce(n.n, 0) AS available FROM sample_targets s LEFT JOIN n ON n.split = s.split AND n.category = s.category),
ranks AS (SELECT request_id, category, sample_size, k, k <= least(min_rows, available) AS floor, (k - 0.5::DOUBLE) / target_share AS priority
  FROM t, unnest(range(1, available + 1)) AS u(k)),
seats AS (SELECT request_id, category FROM ranks
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY floor DESC, priority, category, k) <= sample_size),
d AS (SELECT request_id, category, count(*) AS drawn FROM seats GROUP BY ALL)
SELECT t.request_id, t.split, t.category, t.target_share, t.min_rows, t.sample_size, t.available, coalesce(drawn, 0) AS drawn,
  coalesce(coalesce(drawn, 0) / sum(coalesce(drawn, 0)) OVER (PARTITION BY t.request_id), 0)::DOUBLE AS actual_share,
  available < round(target_share * sample_size, 9) OR available < min_rows AS short
FROM t LEFT JOIN d ON d.request_id = t.request_id AND d.category = t.category"""

P2_SAMPLE = f"""
WITH report AS ({P2_REPORT.strip()}), {_CATEGORISED},
k AS (SELECT item_id, split, category, row_number() OVER (PARTITION BY split, category ORDER BY md5('42:' || item_id), item_id) AS place FROM p)
SELECT request_id, category, item_id, place, (place - 0.5::DOUBLE) / target_share AS priority FROM k JOIN report USING (split, category) WHERE place <= drawn"""

P3 = f"""
WITH RECURSIVE i AS MATERIALIZED (SELECT DISTINCT {STEM} AS s, nullif(hash, 0) AS h FROM items),
n AS MATERIALIZED (SELECT DISTINCT new_id, batch_no, {STEM} AS s, nullif(hash, 0) AS h FROM new_items),
free AS MATERIALIZED (SELECT * FROM n WHERE (s IS NULL OR s NOT IN (SELECT s FROM i WHERE s IS NOT NULL))
    AND NOT EXISTS (SELECT 1 FROM i WHERE bit_count(xor(i.h, n.h)) <= 3)),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY batch_no, new_id) AS k FROM free),
c AS MATERIALIZED (SELECT a.k, list(b.k) AS earlier FROM o a JOIN o b ON b.k < a.k AND (a.s = b.s OR bit_count(xor(a.h, b.h)) <= 3) GROUP BY a.k),
w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken
  UNION ALL
  SELECT w.k + 1, CASE WHEN len(list_intersect(coalesce(c.earlier, []), w.taken)) = 0 THEN list_append(w.taken, w.k + 1) ELSE w.taken END
  FROM w LEFT JOIN c ON c.k = w.k + 1 WHERE w.k < (SELECT count(*) FROM o)),
t AS (SELECT unnest(taken) AS k FROM w WHERE k = (SELECT count(*) FROM o))
SELECT new_id FROM n WHERE new_id {{}} IN (SELECT new_id FROM o WHERE k IN (SELECT k FROM t))"""

P4 = f"""
WITH i AS (SELECT DISTINCT * FROM items WHERE hash <> 0),
m AS (SELECT i.*, d.trust_rank FROM i LEFT JOIN dataset_domains d ON d.dataset = lower(trim(i.dataset))
  WHERE hash IN (SELECT hash FROM i GROUP BY hash HAVING count(*) > 1)),
f AS (SELECT hash, 'num_boxes' AS field, item_id, trust_rank, loaded_at FROM m WHERE num_boxes >= 1
 UNION ALL SELECT hash, 'classes', item_id, trust_rank, loaded_at FROM m WHERE list_has_any(classes, (SELECT list(class_id) FROM class_names))
 UNION ALL SELECT hash, 'domain', item_id, trust_rank, loaded_at FROM m WHERE NOT {_missing('m.domain')}
 UNION ALL SELECT hash, 'licence', item_id, trust_rank, loaded_at FROM m WHERE NOT {_missing('licence')}
 UNION ALL SELECT hash, 'captured_at', item_id, trust_rank, loaded_at FROM m WHERE captured_at IS NOT NULL)
SELECT hash, field, item_id FROM f
QUALIFY row_number() OVER (PARTITION BY hash, field ORDER BY trust_rank NULLS LAST, loaded_at DESC NULLS LAST, item_id) = 1"""

_GROUPED = """
p AS (SELECT least(item_a, item_b) AS a, greatest(item_a, item_b) AS b, lower(trim(verdict)) AS verdict FROM match_pairs
  WHERE item_a <> item_b
  QUALIFY row_number() OVER (PARTITION BY least(item_a, item_b), greatest(item_a, item_b) ORDER BY matched_at DESC NULLS LAST, pair_id DESC) = 1),
e AS MATERIALIZED (SELECT a, b FROM p WHERE verdict = 'match' UNION SELECT b, a FROM p WHERE verdict = 'match'),
r AS (SELECT a AS item_id, a AS other FROM e UNION SELECT r.item_id, e.b FROM r JOIN e ON e.a = r.other),
g AS (SELECT item_id, min(other) AS group_id FROM r GROUP BY item_id)"""

P6 = f"WITH RECURSIVE {_GROUPED} SELECT item_id, group_id FROM g"

P6_ALL = f"""
WITH RECURSIVE {_GROUPED},
i AS (SELECT DISTINCT coalesce(x.item_id, g.item_id) AS item_id, coalesce(group_id, x.item_id) AS group_id FROM (SELECT DISTINCT item_id FROM items) x FULL JOIN g ON g.item_id = x.item_id)
SELECT item_id, group_id, count(*) OVER (PARTITION BY group_id) AS members FROM i"""

P7 = f"""
WITH i AS MATERIALIZED (SELECT DISTINCT item_id, lower(trim(split)) AS split, {STEM} AS s, nullif(hash, 0) AS h FROM items),
p AS (SELECT a.item_id AS t, b.item_id AS e FROM i a JOIN i b ON a.s = b.s WHERE a.split = 'train' AND b.split IN ('val', 'test')
 UNION SELECT a.item_id, b.item_id FROM i a JOIN i b ON bit_count(xor(a.h, b.h)) <= 3 WHERE a.split = 'train' AND b.split IN ('val', 'test'))
SELECT least(t, e) AS item_id_a, greatest(t, e) AS item_id_b FROM p"""

P7_REPORT = f"""
WITH i AS MATERIALIZED (SELECT DISTINCT item_id, lower(trim(split)) AS split, lower(trim(dataset)) AS dataset, {STEM} AS s, nullif(hash, 0) AS h FROM items),
d AS (SELECT e.h, min(bit_count(xor(t.h, e.h))) AS dist FROM (SELECT DISTINCT h FROM i WHERE split IN ('val', 'test')) e
  JOIN (SELECT DISTINCT h FROM i WHERE split = 'train') t ON bit_count(xor(t.h, e.h)) <= 3 GROUP BY e.h),
m AS (SELECT i.*, coalesce(s IN (SELECT s FROM i WHERE split = 'train' AND s IS NOT NULL), false) AS stem, dist FROM i LEFT JOIN d ON d.h = i.h WHERE split IN ('val', 'test'))
SELECT split, dataset, count(*) AS items, count(*) FILTER (stem OR dist IS NOT NULL) AS overlapping, count(*) FILTER (stem) AS same_stem,
  count(*) FILTER (dist = 0) AS same_hash, count(*) FILTER (dist > 0) AS near_hash FROM m GROUP BY split, dataset"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1,
        "p1_splits": P1_SPLITS,
        "p2_found": P2,
        "p2_report": P2_REPORT,
        "p2_sample": P2_SAMPLE,
        "p3_found": P3.format("NOT"),
        "p3_accepted": P3.format(""),
        "p4_found": P4,
        "p6_found": P6,
        "p6_all_items": P6_ALL,
        "p7_found": P7,
        "p7_report": P7_REPORT,
    }
