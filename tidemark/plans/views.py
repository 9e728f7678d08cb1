"""The driver's tables seen as the relations that the operators take, in Spark and in SQL.

SQL views are given as the text of common table expressions, so a statement names the
ones it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bits, text
from tidemark.functions.geometry import to_pixels
from tidemark.operators.mapping import with_domain
from tidemark.operators.neardup import priority

SIDE = 1000.0
MILITARY = [7]
BOXES = "bx AS (SELECT DISTINCT item_id, box_idx, class_id, cx, cy, w, h FROM label_boxes)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str) -> DataFrame:
    """One row an item: ``item_id, dataset, domain, stem, classes, num_boxes, hash, split, military``."""
    raw = table(spark, folder, "items").select("item_id", "dataset", "domain", "stem", "classes", "num_boxes", "hash", "split").distinct()
    known = table(spark, folder, "class_names").select("class_id")
    placed = with_domain(raw, table(spark, folder, "dataset_domains")).select(
        "item_id", text.word(F.col("dataset")).alias("dataset"), "domain", text.stem(F.col("stem")).alias("stem"), "classes",
        F.greatest(F.coalesce("num_boxes", F.lit(0)), F.lit(0)).alias("num_boxes"), bits.real(F.col("hash")).alias("hash"), text.assigned(F.col("split")).alias("split"),
    )
    valid = (
        placed.select("item_id", F.explode("classes").alias("class_id")).join(known, "class_id", "left_semi")
        .groupBy("item_id").agg(F.array_sort(F.collect_set("class_id")).alias("valid"))
    )
    joined = placed.join(valid, "item_id", "left").withColumn("classes", F.coalesce("valid", F.array().cast("array<int>"))).drop("valid")
    return joined.withColumn("military", F.arrays_overlap("classes", F.array(*(F.lit(m) for m in MILITARY))))


def ordered_items(spark: SparkSession, folder: str) -> DataFrame:
    """``items`` with ``turn``, the order in which near-duplicate removal keeps them."""
    rows = items(spark, folder)
    return rows.withColumn("turn", priority(F.col("military"), F.col("num_boxes"), F.col("stem"), F.col("item_id")))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The label lines, each once, as they are."""
    return table(spark, folder, "label_boxes").select("item_id", "box_idx", "class_id", "cx", "cy", "w", "h").distinct()


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """``image_id, class_id, box_idx`` and pixel corners of the boxes with a known class and a size."""
    rows = boxes(spark, folder).join(table(spark, folder, "class_names").select("class_id"), "class_id", "left_semi").where((F.col("w") > 0) & (F.col("h") > 0))
    side = F.lit(SIDE)
    corners = to_pixels(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), side, side)
    return rows.select(F.col("item_id").alias("image_id"), "class_id", "box_idx", *(c.alias(n) for n, c in corners.items()))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Invented detections: the true boxes shifted, with a confidence and for some another class, all drawn from their ids."""
    u = F.pmod(F.col("image_id") * 31 + F.col("box_idx") * 17, F.lit(97))
    shift = lambda a, b, k: (F.pmod(F.floor(u / k), F.lit(7)) - 3) * (F.col(b) - F.col(a)) / 20
    moved = truth(spark, folder).withColumn("u", u).withColumn("dx", shift("x1", "x2", 1)).withColumn("dy", shift("y1", "y2", 7))
    wrong = F.col("u") % 11 == 0
    return moved.select(
        "image_id", F.when(wrong, (F.col("class_id") + 1) % 8).otherwise(F.col("class_id")).alias("class_id"), "box_idx", ((F.col("u") + 1) / 100.0).alias("conf"),
        (F.col("x1") + F.col("dx")).alias("x1"), (F.col("y1") + F.col("dy")).alias("y1"), (F.col("x2") + F.col("dx")).alias("x2"), (F.col("y2") + F.col("dy")).alias("y2"),
    )


def image_domains(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select(F.col("item_id").alias("image_id"), "domain")


SPELL = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
STEM = r"nullif(trim(regexp_replace(lower(trim({0})), '\.(jpg|jpeg|png|bmp|tif|tiff)$', '')), '')"
ITEMS = f"""
raw AS (SELECT DISTINCT * FROM items),
known AS (SELECT list(class_id) AS ids FROM class_names),
it AS (SELECT item_id, lower(trim(r.dataset)) AS dataset,
    coalesce(CASE WHEN coalesce({SPELL.format('r.domain')} NOT IN ('', 'unknown', 'none', 'na', 'null', 'tbd'), false) THEN lower(trim(r.domain)) END, d.domain, 'surface') AS domain,
    {STEM.format('stem')} AS stem, coalesce(list_sort(list_distinct(list_intersect(classes, (SELECT ids FROM known)))), []) AS classes,
    greatest(coalesce(num_boxes, 0), 0) AS num_boxes, nullif(hash, 0) AS hash, nullif(lower(trim(split)), '') AS split
  FROM raw r LEFT JOIN dataset_domains d ON d.dataset = lower(trim(r.dataset))),
im AS (SELECT *, list_contains(classes, 7) AS military FROM it)"""
TRUTH = """
bx AS (SELECT DISTINCT item_id, box_idx, class_id, cx, cy, w, h FROM label_boxes),
tr AS MATERIALIZED (SELECT item_id AS image_id, class_id, box_idx, (cx - w / 2) * 1000.0::DOUBLE AS x1, (cy - h / 2) * 1000.0::DOUBLE AS y1, (cx + w / 2) * 1000.0::DOUBLE AS x2, (cy + h / 2) * 1000.0::DOUBLE AS y2
  FROM bx WHERE class_id IN (SELECT class_id FROM class_names) AND w > 0 AND h > 0)"""
PREDICTIONS = f"""{TRUTH},
pu AS (SELECT *, (image_id * 31 + box_idx * 17) % 97 AS u FROM tr),
pd AS (SELECT *, (u % 7 - 3) * (x2 - x1) / 20 AS dx, (u // 7 % 7 - 3) * (y2 - y1) / 20 AS dy FROM pu),
pr AS MATERIALIZED (SELECT image_id, CASE WHEN u % 11 = 0 THEN (class_id + 1) % 8 ELSE class_id END AS class_id, box_idx, (u + 1) / 100.0::DOUBLE AS conf, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2 FROM pd)"""
_SIDE = "greatest(0.0::DOUBLE, least({a}.{h}, {b}.{h}) - greatest({a}.{l}, {b}.{l}))"


def sql_iou(a: str, b: str) -> str:
    """The overlap of two aliases with corners, as SQL."""
    inter = f"({_SIDE.format(a=a, b=b, l='x1', h='x2')} * {_SIDE.format(a=a, b=b, l='y1', h='y2')})"
    area = lambda t: f"(greatest(0.0::DOUBLE, {t}.x2 - {t}.x1) * greatest(0.0::DOUBLE, {t}.y2 - {t}.y1))"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0::DOUBLE END"
