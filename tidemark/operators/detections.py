"""Detections as they leave a model: thresholds, records, logs and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIRE = "struct<`class`: string, confidence: double, bbox: array<double>, frame: int, timestamp: double>"


def keep(detections: DataFrame, conf: float = 0.25, conf_military: float = 0.10) -> DataFrame:
    """The detections (``group, confidence``) that reach the threshold of their group.

    The weaker of both thresholds is stated on its own, so that a scan can skip by it.
    """
    own = F.when(F.col("group") == "military", conf_military).otherwise(conf)
    return detections.where(F.col("confidence") >= min(conf, conf_military)).where(F.col("confidence") >= own)


def _record(name: Column, confidence: Column, bbox: Column, frame: Column, timestamp: Column) -> Column:
    return F.struct(name.alias("class"), confidence.alias("confidence"), bbox.alias("bbox"), frame.alias("frame"), timestamp.alias("timestamp"))


def to_wire(name: Column, confidence: Column, bbox: Column, frame: Column, timestamp: Column) -> Column:
    """One detection as JSON with the keys class, confidence, bbox, frame, timestamp, null ones too."""
    return F.to_json(_record(name, confidence, bbox, frame, timestamp), {"ignoreNullFields": "false"})


def wire_arrays(detections: DataFrame, key: str) -> DataFrame:
    """``key, records``: the detections of a picture or frame (``class_name, confidence, bbox, frame, timestamp``) as one JSON array, surest first."""
    each = F.struct((-F.col("confidence")).alias("rank"), F.col("class_name").alias("by"), F.col("bbox").alias("box"), _record(*(F.col(c) for c in ("class_name", "confidence", "bbox", "frame", "timestamp"))).alias("record"))
    held = detections.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("held"))
    return held.select(key, F.to_json(F.transform("held", lambda h: h["record"]), {"ignoreNullFields": "false"}).alias("records"))


def from_wire(text: Column) -> Column:
    """The struct of a detection's JSON."""
    return F.from_json(text, WIRE)


def log_rows(detections: DataFrame) -> DataFrame:
    """The columns of a detection log, numbers rounded as they are shown."""
    r = lambda c, n: F.round(F.col(c), n).alias(c)
    return detections.select("frame", r("timestamp_s", 3), F.col("track_id").cast("bigint").alias("track_id"), F.col("class_name").alias("class"), F.col("group"), r("confidence", 4), *(r(c, 1) for c in ("x1", "y1", "x2", "y2")))


def write_log(rows: DataFrame, path: str) -> None:
    """The log as CSV with a header; an untracked detection has an empty track."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def group_summary(detections: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``group, n, mean_confidence, max_confidence, tracks`` with zeros for groups without detections."""
    names = detections.sparkSession.createDataFrame([(g,) for g in groups], "group string")
    held = detections.groupBy("group").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.count_distinct("track_id").alias("tracks")
    )
    return names.join(held, "group", "left").select("group", *(F.coalesce(c, F.lit(z)).alias(c) for c, z in (("n", 0), ("mean_confidence", 0.0), ("max_confidence", 0.0), ("tracks", 0))))


def stub(spark, name: str = "military_vessel") -> DataFrame:
    """Three fixed detections for use without a model."""
    rows = [(name, 0.91, [120.0, 80.0, 420.0, 260.0]), ("cargo", 0.77, [460.0, 110.0, 700.0, 250.0]), ("speedboat", 0.58, [60.0, 300.0, 150.0, 350.0])]
    return spark.createDataFrame(rows, "class_name string, confidence double, bbox array<double>")
