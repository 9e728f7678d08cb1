"""Queries over annotations and the dataset built from them, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.geometry import clamp, to_normalized, to_pixels
from tidemark.functions.pixels import above_median
from tidemark.operators import augment, convert, mapping, naming, neardup, split, validate
from tidemark.plans import views
from tidemark.plans.views import BOXES, ITEMS, STEM, TRUTH
from tidemark.sources import labels, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function."""

    def wrap(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return wrap



def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return views.boxes(spark, folder).select("item_id", "box_idx", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("class_id", "cx", "cy", "w", "h"))).alias("line"))


@query(f"""WITH {BOXES} SELECT item_id, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS classes, count(*) AS num_boxes
FROM bx WHERE class_id IS NOT NULL GROUP BY item_id""")
def q01_label_scan(spark: SparkSession, folder: str) -> DataFrame:
    parsed = labels.yolo(_lines(spark, folder)).where(F.col("class_id").isNotNull() & F.col("cx").isNotNull())
    return labels.per_image(parsed, "item_id").select("item_id", F.concat_ws(",", F.transform("classes", lambda c: c.cast("string"))).alias("classes"), "num_boxes")


@query(f"WITH {BOXES} SELECT item_id, box_idx, round((cx - w / 2) * 640, 4) AS x1, round((cy - h / 2) * 480, 4) AS y1, round((cx + w / 2) * 640, 4) AS x2, round((cy + h / 2) * 480, 4) AS y2 FROM bx")
def q02_pixel_boxes(spark: SparkSession, folder: str) -> DataFrame:
    c = to_pixels(*(F.col(n) for n in ("cx", "cy", "w", "h")), F.lit(640), F.lit(480))
    return views.boxes(spark, folder).select("item_id", "box_idx", *(F.round(v, 4).alias(n) for n, v in c.items()))


# An invented mapping: explicit names, dropped names, a wildcard, and datasets without any.
MAPPING = (
    ("coastcam", "box_carrier", "box_carrier"), ("coastcam", "liquid_carrier", "liquid_carrier"), ("coastcam", "naval_ship", "naval_ship"), ("coastcam", "sail_yacht", None),
    ("satfleet", "*", "trawler"), ("satfleet", "river_ferry", None), ("quayview", "*", None), ("quayview", "bulk_carrier", "bulk_carrier"), ("topdeck", "trawler", "trawlr"),
)
_MAPPING_SQL = "mp(dataset, native, target) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in MAPPING) + ")"


@query(f"""WITH {ITEMS}, {BOXES}, {_MAPPING_SQL},
a AS (SELECT it.dataset, coalesce(c.name, 'other') AS native, bx.w > 0 AND bx.h > 0 AS kept FROM bx JOIN it ON it.item_id = bx.item_id LEFT JOIN class_names c ON c.class_id = bx.class_id),
r AS (SELECT a.*, CASE WHEN e.native IS NOT NULL THEN e.target ELSE w.target END AS target, e.native IS NOT NULL OR w.native IS NOT NULL AS listed FROM a
  LEFT JOIN mp e ON e.dataset = a.dataset AND e.native = a.native LEFT JOIN mp w ON w.dataset = a.dataset AND w.native = '*'),
s AS (SELECT r.*, CASE WHEN NOT listed THEN 'unmapped' WHEN c.class_id IS NULL THEN 'dropped' ELSE 'mapped' END AS reason FROM r LEFT JOIN class_names c ON c.name = r.target)
SELECT dataset, native, count(*) AS seen, count(*) FILTER (reason = 'mapped') AS mapped, count(*) FILTER (reason = 'dropped') AS dropped, count(*) FILTER (reason = 'unmapped') AS unmapped,
  count(*) FILTER (reason = 'mapped' AND kept) AS written, count(*) FILTER (reason = 'mapped' AND NOT kept) AS degenerate FROM s GROUP BY ALL""")
def q03_conversion_counts(spark: SparkSession, folder: str) -> DataFrame:
    classes = views.table(spark, folder, "class_names")
    named = views.boxes(spark, folder).join(classes, "class_id", "left").join(views.items(spark, folder).select("item_id", "dataset"), "item_id")
    annotations = named.select("dataset", F.coalesce("name", F.lit("other")).alias("native"), ((F.col("w") > 0) & (F.col("h") > 0)).alias("kept"))
    mappings = spark.createDataFrame(list(MAPPING), "dataset string, native string, target string")
    return mapping.conversion_counts(mapping.resolve(annotations, mappings, classes), F.col("kept"))


@query(f"WITH {_MAPPING_SQL} SELECT dataset, native, target FROM mp WHERE target IS NOT NULL AND target NOT IN (SELECT name FROM class_names)")
def q03b_mapping_problems(spark: SparkSession, folder: str) -> DataFrame:
    mappings = spark.createDataFrame(list(MAPPING), "dataset string, native string, target string")
    return mapping.mapping_problems(mappings, views.table(spark, folder, "class_names"))


@query(f"WITH {TRUTH} SELECT image_id, class_id::VARCHAR AS native, floor(x1)::DOUBLE AS xmin, floor(y1)::DOUBLE AS ymin, ceil(x2)::DOUBLE AS xmax, ceil(y2)::DOUBLE AS ymax, 1000 AS width FROM tr")
def q04_voc_documents(spark: SparkSession, folder: str) -> DataFrame:
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    side = lambda name, value: tag(name, value.cast("bigint"))
    box = F.concat(F.lit("<bndbox>"), side("xmin", F.floor("x1")), side("ymin", F.floor("y1")), side("xmax", F.ceil("x2")), side("ymax", F.ceil("y2")), F.lit("</bndbox>"))
    one = F.concat(F.lit("<object>"), tag("name", F.col("class_id")), box, F.lit("</object>"))
    per = views.truth(spark, folder).groupBy("image_id").agg(F.array_join(F.collect_list(one), "").alias("body"))
    head = F.concat(F.lit("<annotation>"), tag("filename", F.col("image_id")), F.lit("<size><width>1000</width><height>1000</height></size>"))
    objects, _ = labels.voc_objects(per.select("image_id", F.concat(head, "body", F.lit("</annotation>")).alias("xml")))
    return objects.select("image_id", "native", "xmin", "ymin", "xmax", "ymax", "width")


@query(f"""WITH {TRUTH}, c AS (SELECT image_id, box_idx, class_id, greatest(0.0::DOUBLE, least(floor(x1), 1000.0)) AS a, greatest(0.0::DOUBLE, least(floor(y1), 1000.0)) AS b, greatest(0.0::DOUBLE, least(ceil(x2), 1000.0)) AS c, greatest(0.0::DOUBLE, least(ceil(y2), 1000.0)) AS d FROM tr)
SELECT image_id, box_idx, class_id::VARCHAR AS native, round((a + c) / 2 / 1000, 6) AS cx, round((b + d) / 2 / 1000, 6) AS cy, round((c - a) / 1000, 6) AS w, round((d - b) / 1000, 6) AS h FROM c WHERE c > a AND d > b""")
def q05_oriented_boxes(spark: SparkSession, folder: str) -> DataFrame:
    x1, y1, x2, y2 = F.floor("x1"), F.floor("y1"), F.ceil("x2"), F.ceil("y2")
    lines = views.truth(spark, folder).select("image_id", "box_idx", F.concat_ws(" ", *(c.cast("string") for c in (x1, y1, x2, y1, x2, y2, x1, y2, F.col("class_id"), F.lit(0)))).alias("line"))
    side = F.lit(1000)
    parsed = labels.dota(lines).withColumn("b", clamp(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), side, side)).where(F.col("b").isNotNull())
    return parsed.select("image_id", "box_idx", "native", *(F.round(v, 6).alias(n) for n, v in to_normalized(F.col("b"), side, side).items()))


@query(f"WITH {ITEMS} SELECT item_id, dataset AS native, dataset || '__' || stem AS stem FROM it WHERE stem IS NOT NULL AND dataset IS NOT NULL")
def q06_folder_classes(spark: SparkSession, folder: str) -> DataFrame:
    files = views.items(spark, folder).where(F.col("stem").isNotNull() & F.col("dataset").isNotNull()).select("item_id", F.concat(F.lit("raw/"), "dataset", F.lit("/"), "stem", F.lit(".jpg")).alias("path"))
    return labels.folder_classes(files).select("item_id", "native", "stem")


@query(rf"""WITH f AS (SELECT {STEM.format('stem')} AS s, regexp_extract(lower(trim(stem)), '\.(jpg|jpeg|png|bmp|tif|tiff)$', 1) AS ext, stem AS path FROM items),
g AS (SELECT s, CASE WHEN ext = '' THEN 'webp' ELSE ext END AS ext, path FROM f WHERE s IS NOT NULL)
SELECT s AS stem, ext, path FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY list_position(['jpg', 'jpeg', 'png', 'bmp', 'tif', 'tiff', 'webp'], ext), path) = 1""")
def q07_image_for_stem(spark: SparkSession, folder: str) -> DataFrame:
    ext = F.regexp_extract(F.lower(F.trim("stem")), r"\.(jpg|jpeg|png|bmp|tif|tiff)$", 1)
    files = views.table(spark, folder, "items").select(text.stem(F.col("stem")).alias("s"), F.when(ext == "", "webp").otherwise(ext).alias("ext"), F.col("stem").alias("path"))
    return naming.image_for_stem(files.where(F.col("s").isNotNull()).withColumnRenamed("s", "stem"))


@query(f"WITH {ITEMS}, {BOXES} SELECT domain, count(*) AS instances FROM im JOIN bx ON bx.item_id = im.item_id WHERE split = 'train' AND class_id = 7 GROUP BY domain")
def q08_military_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    held = views.boxes(spark, folder).where(F.col("class_id").isin(*views.MILITARY)).select("item_id")
    train = views.items(spark, folder).where(F.col("split") == "train").select("item_id", "domain")
    return held.join(train, "item_id").groupBy("domain").agg(F.count("*").alias("instances"))


@query(f"WITH {ITEMS} SELECT stem, item_id FROM it WHERE stem IS NOT NULL ORDER BY stem, item_id LIMIT 500 OFFSET 100")
def q09_sorted_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The feature: a stretch of the sorted pictures, for runs in several processes."""
    return views.items(spark, folder).where(F.col("stem").isNotNull()).select("stem", "item_id").orderBy("stem", "item_id").offset(100).limit(500)


@query(f"""WITH r AS (SELECT {STEM.format('stem')} AS stem, item_id, loaded_at FROM items)
SELECT stem, item_id, loaded_at FROM r WHERE stem IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stem ORDER BY loaded_at NULLS FIRST, item_id) = 1""")
def q10_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "items").select(text.stem(F.col("stem")).alias("stem"), "item_id", "loaded_at").where(F.col("stem").isNotNull())
    return results.keep_first(rows, "stem", ["loaded_at", "item_id"])


@query(f"""WITH {BOXES}, p AS (SELECT item_id, box_idx, (cx - w / 2) * 640 AS x1, (cy - h / 2) * 480 AS y1, (cx + w / 2) * 640 AS x2, (cy + h / 2) * 480 AS y2 FROM bx),
c AS (SELECT item_id, box_idx, greatest(0.0::DOUBLE, least(least(x1, x2), 640.0::DOUBLE)) AS a, greatest(0.0::DOUBLE, least(least(y1, y2), 480.0::DOUBLE)) AS b, greatest(0.0::DOUBLE, least(greatest(x1, x2), 640.0::DOUBLE)) AS c, greatest(0.0::DOUBLE, least(greatest(y1, y2), 480.0::DOUBLE)) AS d FROM p)
SELECT item_id, box_idx, NOT (c > a AND d > b) AS degenerate, CASE WHEN c > a AND d > b THEN round((a + c) / 2 / 640, 6) END AS cx, CASE WHEN c > a AND d > b THEN round((b + d) / 2 / 480, 6) END AS cy,
  CASE WHEN c > a AND d > b THEN round((c - a) / 640, 6) END AS w, CASE WHEN c > a AND d > b THEN round((d - b) / 480, 6) END AS h FROM c""")
def q11_clamped(spark: SparkSession, folder: str) -> DataFrame:
    w, h = F.lit(640), F.lit(480)
    c = to_pixels(*(F.col(n) for n in ("cx", "cy", "w", "h")), w, h)
    boxed = views.boxes(spark, folder).select("item_id", "box_idx", clamp(c["x1"], c["y1"], c["x2"], c["y2"], w, h).alias("b"))
    return boxed.select("item_id", "box_idx", F.col("b").isNull().alias("degenerate"), *(F.round(v, 6).alias(n) for n, v in to_normalized(F.col("b"), w, h).items()))


_CUT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"


@query(f"""WITH {BOXES}, p AS (SELECT item_id, box_idx, class_id, {_CUT.format('cx - w / 2')} AS a, {_CUT.format('cx')} AS m, {_CUT.format('cx + w / 2')} AS c, {_CUT.format('cy - h / 2')} AS b, {_CUT.format('cy')} AS n, {_CUT.format('cy + h / 2')} AS d FROM bx WHERE class_id IS NOT NULL AND cx + cy + w + h IS NOT NULL),
e AS (SELECT item_id, box_idx, class_id, least(a, m, c) AS x1, greatest(a, m, c) AS x2, least(b, n, d) AS y1, greatest(b, n, d) AS y2 FROM p)
SELECT item_id, box_idx, class_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM e""")
def q12_polygon_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Diamonds written as polygon label lines and read back as boxes."""
    x, y, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    points = (x - w / 2, y, x, y - h / 2, x + w / 2, y, x, y + h / 2)
    lines = views.boxes(spark, folder).where(F.col("class_id").isNotNull()).select("item_id", "box_idx", F.concat_ws(" ", "class_id", *(p.cast("string") for p in points)).alias("line"))
    parsed = labels.yolo(lines).where(F.col("cx").isNotNull())
    return parsed.select("item_id", "box_idx", "class_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")))


GROUPS = (*(("civilian", k) for k in (0, 1, 2, 3, 4)), *(("small_craft", k) for k in (4, 5)), ("military", 7))
_GROUPS_SQL = 'gr("group", class_id) AS (VALUES ' + ", ".join(f"('{g}', {k})" for g, k in GROUPS) + ")"


@query(f"""WITH {_GROUPS_SQL} SELECT c.class_id, c.name, coalesce((SELECT g."group" FROM gr g WHERE g.class_id = c.class_id ORDER BY list_position(['military', 'small_craft', 'civilian'], g."group") LIMIT 1), 'other') AS "group" FROM class_names c""")
def q13_class_groups(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.class_groups(views.table(spark, folder, "class_names"), spark.createDataFrame(list(GROUPS), "group string, class_id int"))


@query(f"""WITH {ITEMS}, r AS (SELECT item_id AS id, dataset AS stem, row_number() OVER (PARTITION BY dataset ORDER BY md5(item_id::VARCHAR), item_id) AS k FROM it WHERE dataset IS NOT NULL)
SELECT id, stem, CASE WHEN k = 1 THEN stem ELSE stem || '_' || (k - 1) END AS unique_stem FROM r""")
def q14_unique_stems(spark: SparkSession, folder: str) -> DataFrame:
    return naming.unique_stems(views.items(spark, folder).where(F.col("dataset").isNotNull()).select(F.col("item_id").alias("id"), F.col("dataset").alias("stem")))


@query("""WITH s AS (SELECT vec_id, embedding AS e, list_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS o FROM embeddings),
b AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN x::DOUBLE > (o[32] + o[33]) / 2 THEN '1' ELSE '0' END) AS bits FROM s)
SELECT vec_id, array_to_string(bits, '') AS bits FROM b""")
def q15_median_bits(spark: SparkSession, folder: str) -> DataFrame:
    hashed = views.table(spark, folder, "embeddings").select("vec_id", above_median(F.col("embedding")).alias("hash"))
    return hashed.select("vec_id", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


@query(f"""WITH {ITEMS}, h AS MATERIALIZED (SELECT DISTINCT hash FROM it WHERE hash IS NOT NULL)
SELECT a.hash AS hash_a, b.hash AS hash_b, bit_count(xor(a.hash, b.hash))::INT AS dist FROM h a JOIN h b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 5""")
def q16_near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    hashes = views.items(spark, folder).select("hash").where(F.col("hash").isNotNull()).distinct()
    return neardup.banded_pairs(hashes, threshold=5)


_GREEDY = f"""{ITEMS},
og AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY NOT military, -num_boxes, stem NULLS FIRST, item_id) AS k FROM im WHERE hash IS NOT NULL),
near AS MATERIALIZED (SELECT b.k AS k, list(a.k) AS earlier FROM og a JOIN og b ON a.k < b.k AND bit_count(xor(a.hash, b.hash)) <= 3 GROUP BY b.k),
st AS MATERIALIZED (SELECT k, row_number() OVER (ORDER BY k) AS step FROM near),
w AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS gone
  UNION ALL SELECT w.step + 1, CASE WHEN len(list_filter(near.earlier, lambda e: NOT list_contains(w.gone, e))) > 0 THEN list_append(w.gone, st.k) ELSE w.gone END
  FROM w JOIN st ON st.step = w.step + 1 JOIN near ON near.k = st.k),
lost AS MATERIALIZED (SELECT unnest(gone) AS k FROM w WHERE step = (SELECT count(*) FROM st)),
best AS (SELECT b.item_id, a.item_id AS rep_id, bit_count(xor(a.hash, b.hash))::INT AS dist, a.military AS rep_military, b.military FROM og a JOIN og b ON a.k < b.k AND bit_count(xor(a.hash, b.hash)) <= 3
  WHERE b.k IN (SELECT k FROM lost) AND a.k NOT IN (SELECT k FROM lost) QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY bit_count(xor(a.hash, b.hash)), a.k) = 1)"""


def _drops(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.items(spark, folder).select("item_id", "military")
    dropped = neardup.greedy_dedup(views.ordered_items(spark, folder)).where(~F.col("kept"))
    return dropped.join(rows, "item_id").join(rows.select(F.col("item_id").alias("rep_id"), F.col("military").alias("rep_military")), "rep_id")


@query(f"""WITH RECURSIVE {_GREEDY}, g AS (SELECT rep_id, count(*) AS n FROM best GROUP BY rep_id),
s AS (SELECT count(*) AS groups, coalesce(max(n + 1), 0) AS largest, round(avg(n + 1), 6) AS mean_size, coalesce(sum(n) FILTER (n + 1 > 10), 0)::BIGINT AS drops_in_large FROM g),
t AS (SELECT count(*) AS dropped, count(*) FILTER (military OR rep_military) AS military_pairs, count(*) FILTER (dist = 0) AS exact FROM best)
SELECT s.*, t.*, coalesce(round(military_pairs * 100.0::DOUBLE / nullif(dropped, 0), 6), 0) AS military_percent FROM s, t""")
def q17_dedup_audit(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.audit_totals(_drops(spark, folder))


@query(f"WITH RECURSIVE {_GREEDY} SELECT dist, count(*) AS dropped FROM best GROUP BY dist")
def q17b_drop_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _drops(spark, folder).groupBy("dist").agg(F.count("*").alias("dropped"))


@query(f"WITH RECURSIVE {_GREEDY}, g AS (SELECT rep_id, count(*) + 1 AS size FROM best GROUP BY rep_id) SELECT size, count(*) AS groups FROM g GROUP BY size")
def q17c_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups of a kept picture and its drops there are of each size."""
    sizes = _drops(spark, folder).groupBy("rep_id").agg((F.count("*") + 1).alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


@query(f"WITH RECURSIVE {_GREEDY} SELECT it.item_id, best.item_id IS NULL AS kept, rep_id, dist FROM it LEFT JOIN best ON best.item_id = it.item_id")
def q18_greedy_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.greedy_dedup(views.ordered_items(spark, folder))


@query(f"""WITH RECURSIVE {_GREEDY}, r AS (SELECT *, row_number() OVER (ORDER BY md5(item_id::VARCHAR), item_id) AS k, count(*) OVER () AS n FROM best),
picks AS (SELECT DISTINCT floor(j * (SELECT max(n) FROM r) / 40.0::DOUBLE)::BIGINT + 1 AS k FROM range(40) t(j)),
top AS (SELECT item_id FROM best WHERE military OR rep_military ORDER BY dist DESC, item_id LIMIT 5)
SELECT item_id, rep_id, dist FROM r WHERE k IN (SELECT k FROM picks) OR item_id IN (SELECT item_id FROM top)""")
def q19_audit_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The feature: forty evenly spaced drops and the five farthest that involve a military item."""
    from tidemark.operators.ranking import hashed_rank
    from tidemark.session import Scratch

    drops = Scratch(spark, "audit").save(_drops(spark, folder), "drops")
    total = drops.agg(F.count("*").alias("n"))
    picks = total.select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j"), "n").select((F.floor(F.col("j") * F.col("n") / 40.0) + 1).alias("place")).distinct()
    even = hashed_rank(drops.withColumn("all", F.lit(1)), ["all"], F.md5(F.col("item_id").cast("string")), "item_id").join(picks, "place", "left_semi")
    far = drops.where(F.col("military") | F.col("rep_military")).orderBy(F.desc("dist"), "item_id").limit(5)
    return even.select("item_id", "rep_id", "dist").unionAll(far.select("item_id", "rep_id", "dist")).distinct()


@query(f"""WITH RECURSIVE {_GREEDY}, r AS (SELECT *, row_number() OVER (ORDER BY dist, md5(item_id::VARCHAR), item_id) AS k, count(*) OVER () AS n FROM best),
picks AS (SELECT DISTINCT floor(j * ((SELECT max(n) FROM r) / 40.0::DOUBLE))::BIGINT + 1 AS k FROM range(40) t(j)),
top AS (SELECT item_id FROM best WHERE military OR rep_military ORDER BY dist DESC, item_id LIMIT 5)
SELECT item_id, rep_id, dist FROM r WHERE k IN (SELECT k FROM picks) OR item_id IN (SELECT item_id FROM top)""")
def q19b_audit_by_distance(spark: SparkSession, folder: str) -> DataFrame:
    """As ``q19_audit_sample``, but evenly spaced in the order of distance, so that exact copies and far drops are both seen."""
    return neardup.audit_sample(_drops(spark, folder))


@query(rf"""WITH {BOXES}, n AS (SELECT *, class_id IS NULL OR cx IS NULL OR cy IS NULL OR w IS NULL OR h IS NULL AS short FROM bx),
v AS (SELECT item_id, box_idx, unnest(list_filter([CASE WHEN short THEN 'fields' END, CASE WHEN NOT short AND class_id NOT BETWEEN 0 AND 7 THEN 'class_range' END,
  CASE WHEN NOT short AND cx NOT BETWEEN 0 AND 1 THEN 'coord_range' END, CASE WHEN NOT short AND cy NOT BETWEEN 0 AND 1 THEN 'coord_range' END, CASE WHEN NOT short AND w NOT BETWEEN 0 AND 1 THEN 'coord_range' END,
  CASE WHEN NOT short AND h NOT BETWEEN 0 AND 1 THEN 'coord_range' END, CASE WHEN NOT short AND (w <= 0 OR h <= 0) THEN 'size' END], lambda x: x IS NOT NULL)) AS rule FROM n)
SELECT item_id, box_idx, rule FROM v""")
def q20_line_violations(spark: SparkSession, folder: str) -> DataFrame:
    return validate.line_violations(_lines(spark, folder), 8).select("item_id", "box_idx", "rule")


@query(f"""WITH {ITEMS}, sp AS (SELECT DISTINCT split, stem FROM it WHERE split IS NOT NULL AND stem IS NOT NULL), sh AS (SELECT DISTINCT split, hash FROM it WHERE split IS NOT NULL AND hash IS NOT NULL),
a AS (SELECT x.split AS split_a, y.split AS split_b, count(*) AS n FROM sp x JOIN sp y ON x.stem = y.stem AND x.split < y.split GROUP BY ALL),
b AS (SELECT x.split AS split_a, y.split AS split_b, count(*) AS n FROM sh x JOIN sh y ON x.split < y.split AND bit_count(xor(x.hash, y.hash)) <= 3 GROUP BY ALL)
SELECT coalesce(a.split_a, b.split_a) AS split_a, coalesce(a.split_b, b.split_b) AS split_b, coalesce(a.n, 0) AS same_stem, coalesce(b.n, 0) AS near_hash FROM a FULL JOIN b ON a.split_a = b.split_a AND a.split_b = b.split_b""")
def q20b_leakage(spark: SparkSession, folder: str) -> DataFrame:
    return validate.leakage(views.items(spark, folder).select("split", "stem", "hash"))


@query(f"""WITH {ITEMS}, i AS (SELECT DISTINCT coalesce(split, '') AS split, item_id::VARCHAR AS stem FROM it), l AS (SELECT DISTINCT coalesce(it.split, '') AS split, b.item_id::VARCHAR AS stem FROM label_boxes b LEFT JOIN it ON it.item_id = b.item_id WHERE b.class_id IN (SELECT class_id FROM class_names))
SELECT split, stem, 'image_without_label' AS rule FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.split = i.split AND l.stem = i.stem)
UNION ALL SELECT split, stem, 'label_without_image' FROM l WHERE NOT EXISTS (SELECT 1 FROM i WHERE l.split = i.split AND l.stem = i.stem)""")
def q20c_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """All images, and all labels of a class there is; those without a split are one more place."""
    rows = views.items(spark, folder).select("item_id", F.coalesce("split", F.lit("")).alias("split"))
    name = F.col("item_id").cast("string").alias("stem")
    known = views.boxes(spark, folder).join(views.table(spark, folder, "class_names").select("class_id").distinct(), "class_id", "left_semi")
    held = known.select("item_id").distinct().join(rows, "item_id", "left").select(F.coalesce("split", F.lit("")).alias("split"), name)
    return validate.orphans(rows.select("split", name), held)


@query(f"""WITH {BOXES}, e AS (SELECT CASE WHEN class_id IS NULL THEN 1 ELSE coalesce((class_id NOT BETWEEN 0 AND 7)::INT + (cx NOT BETWEEN 0 AND 1)::INT + (cy NOT BETWEEN 0 AND 1)::INT
  + (w NOT BETWEEN 0 AND 1)::INT + (h NOT BETWEEN 0 AND 1)::INT + (w <= 0 OR h <= 0)::INT, 0) END AS n FROM bx)
SELECT count(*) AS boxes, sum(n)::BIGINT AS errors, sum(n) = 0 AS ok FROM e""")
def q20d_report(spark: SparkSession, folder: str) -> DataFrame:
    return validate.report(_lines(spark, folder), 8)


_SPLIT = f"""{ITEMS}, cl AS (SELECT item_id, unnest(classes) AS c FROM im), fr AS (SELECT c, count(*) AS n FROM cl GROUP BY c),
ra AS (SELECT item_id, cl.c FROM cl JOIN fr ON fr.c = cl.c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n, cl.c) = 1),
s0 AS (SELECT im.item_id, domain, coalesce(ra.c, -1) AS class_id, stem FROM im LEFT JOIN ra ON ra.item_id = im.item_id),
s1 AS (SELECT *, row_number() OVER (PARTITION BY domain, class_id ORDER BY md5('42|' || coalesce(stem, '')), item_id) AS k, count(*) OVER (PARTITION BY domain, class_id) AS n FROM s0),
s2 AS (SELECT *, n * (1.0::DOUBLE - 0.2 - 0.1) AS et, n * 0.2::DOUBLE AS ev, n * 0.1::DOUBLE AS ee FROM s1),
s3 AS (SELECT *, et - floor(et) AS ft, ev - floor(ev) AS fv, ee - floor(ee) AS fe, n - floor(et) - floor(ev) - floor(ee) AS rest FROM s2),
s4 AS (SELECT *, floor(et) + ((fv > ft)::INT + (fe > ft)::INT < rest)::INT AS nt, floor(ev) + ((ft >= fv)::INT + (fe > fv)::INT < rest)::INT AS nv FROM s3),
sp AS (SELECT item_id, domain, class_id, CASE WHEN k <= nt THEN 'train' WHEN k <= nt + nv THEN 'val' ELSE 'test' END AS split FROM s4)"""


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return split.stratified_split(views.items(spark, folder).select("item_id", "stem", "domain", "classes"))


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def q21_stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)


@query(f"WITH {_SPLIT} SELECT sp.split, im.domain, dataset, stem, num_boxes, array_to_string(classes, '|') AS classes FROM im JOIN sp ON sp.item_id = im.item_id")
def q22_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return split.manifest(views.items(spark, folder).drop("split", "domain").join(_split(spark, folder).drop("class_id"), "item_id"))


@query(f"WITH {ITEMS} SELECT split, stem, min(domain) AS domain FROM it WHERE split IS NOT NULL AND stem IS NOT NULL GROUP BY split, stem")
def q22b_domain_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The domain map of each split as JSON, read back."""
    rows = views.items(spark, folder).where(F.col("split").isNotNull() & F.col("stem").isNotNull())
    return results.flat_domains(results.domain_json(rows.select("split", "stem", "domain")))


@query(f"WITH {ITEMS} SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM it GROUP BY dataset")
def q23_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return split.by_split(views.items(spark, folder), "dataset")


@query(f"""WITH {ITEMS}, c AS (SELECT split, unnest(classes) AS class_id FROM im) SELECT n.class_id, n.name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM class_names n LEFT JOIN c ON c.class_id = n.class_id GROUP BY ALL""")
def q24_class_by_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.class_by_split(views.items(spark, folder), views.table(spark, folder, "class_names"))


@query(f"WITH {ITEMS} SELECT domain, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM it GROUP BY domain")
def q25_domain_by_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.by_split(views.items(spark, folder), "domain")


@query(f"WITH {ITEMS}, c AS (SELECT domain, unnest(classes) AS class_id FROM im) SELECT domain, class_id, count(*) AS n, grouping(domain, class_id)::INT AS level FROM c GROUP BY CUBE (domain, class_id)")
def q26_domain_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return split.domain_by_class(views.items(spark, folder))


@query(f"""WITH RECURSIVE {ITEMS}, h AS MATERIALIZED (SELECT * FROM im WHERE hash IS NOT NULL),
e AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b FROM h a JOIN h b ON a.item_id <> b.item_id AND bit_count(xor(a.hash, b.hash)) <= 3),
r AS (SELECT DISTINCT a AS item_id, a AS other FROM e UNION SELECT r.item_id, e.b FROM r JOIN e ON e.a = r.other),
g AS (SELECT item_id, min(other) AS cluster_id FROM r GROUP BY item_id)
SELECT g.item_id, cluster_id, first_value(g.item_id) OVER (PARTITION BY cluster_id ORDER BY num_boxes DESC, military DESC, stem DESC NULLS LAST, g.item_id DESC) AS rep_id FROM g JOIN h ON h.item_id = g.item_id""")
def q28c_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.single_linkage(views.items(spark, folder).select("item_id", "hash", "num_boxes", "military", "stem"))


_PIC = 1000.0


def _pasting(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Military instances, backgrounds and boxes of the train pictures."""
    places = views.items(spark, folder).where(F.col("split") == "train").select(F.col("item_id").alias("image_id"), "domain")
    boxes = views.truth(spark, folder).join(places, "image_id")
    found = augment.instances(boxes, views.MILITARY).withColumn("instance_id", F.col("image_id") * 1000 + F.col("box_idx"))
    return found.select("instance_id", "domain", "x1", "y1", "x2", "y2"), places, boxes.select("image_id", "x1", "y1", "x2", "y2")


@query(None)
def q33_paste_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Compared with brute force in the tests."""
    return augment.plan_pastes(*_pasting(spark, folder), _PIC, _PIC)


@query(None)
def q33b_cross_domain_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Compared with brute force in the tests. Pictures are not composed here, so none is rejected by its hash."""
    return augment.plan_cross_domain(*_pasting(spark, folder), _PIC, _PIC)


@query(f"""WITH {ITEMS}, cur AS (SELECT CASE WHEN military THEN 'augcp_' || item_id ELSE stem END AS stem, min(domain) AS domain FROM im WHERE stem IS NOT NULL GROUP BY 1),
ad AS (SELECT stem, 'surface_synth' AS domain FROM im WHERE num_boxes > 6 AND stem IS NOT NULL GROUP BY stem),
k AS (SELECT * FROM cur WHERE NOT regexp_matches(stem, '^aug(cp|os|xd)_'))
SELECT coalesce(ad.stem, k.stem) AS stem, coalesce(ad.domain, k.domain) AS domain FROM k FULL JOIN ad ON ad.stem = k.stem""")
def q34_domain_update(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.items(spark, folder).where(F.col("stem").isNotNull())
    current = rows.select(F.when(F.col("military"), F.concat(F.lit("augcp_"), "item_id")).otherwise(F.col("stem")).alias("stem"), "domain").groupBy("stem").agg(F.min("domain").alias("domain"))
    added = rows.where(F.col("num_boxes") > 6).select("stem", F.lit("surface_synth").alias("domain")).distinct()
    return augment.update_domains(current, added)


def _clear_of_holdout(spark: SparkSession, folder: str, threshold: int) -> DataFrame:
    rows = views.items(spark, folder)
    held = rows.where(F.col("split").isin("val", "test")).select("hash")
    return neardup.reject_near(rows.where(F.col("split") == "train").select("item_id", "hash"), held, threshold).select("item_id")


@query(f"""WITH {ITEMS}, h AS MATERIALIZED (SELECT DISTINCT hash FROM it WHERE split IN ('val', 'test') AND hash IS NOT NULL)
SELECT item_id FROM it WHERE split = 'train' AND (hash IS NULL OR NOT EXISTS (SELECT 1 FROM h WHERE bit_count(xor(h.hash, it.hash)) <= 3))""")
def q39_holdout_reject(spark: SparkSession, folder: str) -> DataFrame:
    """Train items farther than near-duplicates from all held-out ones; ``q39b_leak_guard`` is the wider guard."""
    return _clear_of_holdout(spark, folder, threshold=3)


@query(f"""WITH {ITEMS}, h AS MATERIALIZED (SELECT DISTINCT hash FROM it WHERE split IN ('val', 'test') AND hash IS NOT NULL)
SELECT item_id FROM it WHERE split = 'train' AND (hash IS NULL OR NOT EXISTS (SELECT 1 FROM h WHERE bit_count(xor(h.hash, it.hash)) <= 5))""")
def q39b_leak_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Train items that the guard against leaks lets pass: five bits, as for generated pictures."""
    return _clear_of_holdout(spark, folder, threshold=5)


@query(r"""WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS p FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(p)))::INT AS row_no, p FROM l),
r AS (SELECT doc_id, row_no, p[row_no + 1] AS line FROM u)
SELECT doc_id, row_no, array_to_string(list_transform(string_split(regexp_replace(line, '^[ \t]*\||\|[ \t]*$', '', 'g'), '|'), lambda c: trim(c)), '/') AS cells FROM r
WHERE regexp_full_match(line, '[ \t]*\|.*\|[ \t]*', 's') AND NOT regexp_full_match(line, '[ \t|:-]+', 's')""")
def q41_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = views.table(spark, folder, "documents").select("doc_id", "text")
    return results.scrape_tables(docs).select("doc_id", "row_no", F.array_join("cells", "/").alias("cells"))


# Items stand for the label files; those that name a stem have an image. Ids 0 to 6 are the source's classes.
_SOURCE = f"""{ITEMS}, {BOXES}, {_MAPPING_SQL}, nm AS (SELECT * FROM class_names WHERE class_id < 7),
f AS (SELECT item_id, stem IS NOT NULL AS pictured FROM it),
l AS (SELECT bx.*, nm.name, CASE WHEN e.native IS NOT NULL THEN e.target ELSE w.target END AS target, e.native IS NOT NULL OR w.native IS NOT NULL AS listed
  FROM bx JOIN f ON f.item_id = bx.item_id AND f.pictured LEFT JOIN nm ON nm.class_id = bx.class_id
  LEFT JOIN mp e ON e.dataset = 'coastcam' AND e.native = nm.name LEFT JOIN mp w ON w.dataset = 'coastcam' AND w.native = '*'),
j AS (SELECT l.item_id, l.box_idx, c.class_id, CASE WHEN l.class_id IS NULL THEN 'bad_line' WHEN l.name IS NULL THEN 'out_of_range' WHEN NOT listed THEN 'unmapped' WHEN c.class_id IS NULL THEN 'dropped'
  WHEN cx IS NULL OR cy IS NULL OR w IS NULL OR h IS NULL THEN 'malformed' ELSE 'written' END AS outcome FROM l LEFT JOIN class_names c ON c.name = l.target),
k AS (SELECT DISTINCT item_id FROM j WHERE outcome = 'written')"""


def _converted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = views.items(spark, folder)
    files = items.select(F.lit("src").alias("root"), F.col("item_id").cast("string").alias("stem"))
    images = items.where(F.col("stem").isNotNull()).select(F.lit("src").alias("root"), F.col("item_id").cast("string").alias("stem"), F.lit("jpg").alias("ext"), F.col("stem").alias("path"))
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    lines = views.boxes(spark, folder).select(F.lit("src").alias("root"), F.col("item_id").cast("string").alias("stem"), F.concat_ws(" ", *(written(c) for c in ("class_id", "cx", "cy", "w", "h"))).alias("line"))
    classes = views.table(spark, folder, "class_names")
    names = [r["name"] for r in classes.where("class_id < 7").orderBy("class_id").collect()]
    return convert.convert_yolo(files, lines, images, names, "coastcam", spark.createDataFrame(list(MAPPING), "dataset string, native string, target string"), classes)


@query(f"WITH {_SOURCE} SELECT item_id::VARCHAR AS stem, class_id, count(*) AS n FROM j WHERE outcome = 'written' GROUP BY ALL")
def q43_converted_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _converted(spark, folder)[0].groupBy("stem", "class_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_SOURCE} SELECT 'line' AS part, outcome, count(*) AS n FROM j GROUP BY outcome
UNION ALL SELECT 'file', CASE WHEN NOT pictured THEN 'no_image' WHEN k.item_id IS NOT NULL THEN 'written' ELSE 'no_labels' END AS outcome, count(*) FROM f LEFT JOIN k ON k.item_id = f.item_id GROUP BY ALL""")
def q43b_conversion_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _converted(spark, folder)[1]


# Items stand for label files below the folder of their dataset; those that name a stem have an image.
_INTERIM = f"""{ITEMS}, {BOXES}, f AS (SELECT item_id, dataset, stem IS NOT NULL AS pictured FROM it WHERE dataset IS NOT NULL),
b AS (SELECT item_id, count(*) AS num_boxes, string_agg(DISTINCT class_id::VARCHAR, ',' ORDER BY class_id::VARCHAR) AS classes FROM bx WHERE class_id IS NOT NULL GROUP BY item_id),
c AS (SELECT f.*, num_boxes, classes, CASE WHEN NOT pictured THEN 'no_image' WHEN num_boxes IS NULL THEN 'empty_label' ELSE 'collected' END AS outcome FROM f LEFT JOIN b ON b.item_id = f.item_id)"""


def _collected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = views.items(spark, folder).where(F.col("dataset").isNotNull())
    name = F.col("item_id").cast("string").alias("stem")
    root = F.concat(F.lit("interim/"), "dataset").alias("root")
    files = items.select(root, name)
    images = items.where(F.col("stem").isNotNull()).select(root, name, F.lit("jpg").alias("ext"), F.col("stem").alias("path"))
    boxes = views.boxes(spark, folder).where(F.col("class_id").isNotNull()).join(items.select("item_id", "dataset"), "item_id")
    lines = boxes.select(root, name, F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("class_id", "cx", "cy", "w", "h"))).alias("line"))
    return convert.collect_items(files, lines, images, views.table(spark, folder, "dataset_domains").select("dataset", "domain"), "surface")


@query(f"""WITH {_INTERIM} SELECT c.dataset, coalesce(d.domain, 'surface') AS domain, c.dataset || '__' || item_id AS stem, classes, num_boxes FROM c
LEFT JOIN (SELECT dataset, min(domain) AS domain FROM dataset_domains GROUP BY dataset) d ON d.dataset = c.dataset WHERE outcome = 'collected'""")
def q44_collected_items(spark: SparkSession, folder: str) -> DataFrame:
    found = _collected(spark, folder)[0]
    return found.select("dataset", "domain", "stem", F.concat_ws(",", F.transform("classes", lambda c: c.cast("string"))).alias("classes"), "num_boxes")


@query(f"WITH {_INTERIM} SELECT dataset, outcome, count(*) AS n FROM c GROUP BY dataset, outcome")
def q44b_collection_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _collected(spark, folder)[1]


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
