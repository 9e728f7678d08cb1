"""Readers of label files. Every reader gives one row for an annotation, with the file it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.geometry import envelope, let, yolo_shape

VOC_SCHEMA = (
    "struct<filename: string, size: struct<width: int, height: int>, "
    "object: array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>>"
)


def stem_of(path: Column) -> Column:
    """The file name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_lines(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``path, stem, line`` of all text files below a folder, blank lines left out."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.length(F.trim("line")) > 0).withColumn("stem", stem_of(F.col("path")))


def yolo(lines: DataFrame) -> DataFrame:
    """``lines`` (with ``line``) and ``class_id, cx, cy, w, h``; polygons as their envelopes, null where the line is malformed."""
    def parsed(t: Column) -> Column:
        numbers = F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), scalars.number)
        shape = let(numbers, lambda c: F.when(F.forall(c, lambda v: v.isNotNull()), yolo_shape(c)))
        return let(shape, lambda s: F.struct(scalars.class_id(F.get(t, F.lit(0))).alias("class_id"), *(s[c].alias(c) for c in ("cx", "cy", "w", "h"))))

    rows = lines.withColumn("_s", let(scalars.tokens(F.col("line")), parsed))
    return rows.select(*lines.columns, *(F.col("_s")[c].alias(c) for c in ("class_id", "cx", "cy", "w", "h")))


def per_image(labels: DataFrame, key: str = "stem") -> DataFrame:
    """``key, classes, num_boxes`` of labels with ``class_id``; images without a label have no row."""
    return labels.groupBy(key).agg(F.array_sort(F.collect_set("class_id")).alias("classes"), F.count("*").alias("num_boxes"))


def dota(lines: DataFrame) -> DataFrame:
    """``lines`` and ``native, x1, y1, x2, y2`` of oriented boxes: eight numbers and a category; other lines are left out."""
    def parsed(t: Column) -> Column:
        corners = F.transform(F.slice(t, 1, 8), scalars.number)
        return F.when(F.size(t) >= 9, F.struct(F.get(t, F.lit(8)).alias("native"), let(corners, envelope).alias("box")))

    rows = lines.withColumn("_d", let(scalars.tokens(F.col("line")), parsed)).where(F.col("_d.box").isNotNull())
    return rows.select(*lines.columns, F.col("_d.native").alias("native"), *(F.col(f"_d.box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


def voc_objects(documents: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """``(objects, rejects)`` of annotation documents in a column.

    ``objects``: the other columns and ``filename, width, height, native, xmin, ymin, xmax, ymax``; one row with null
    ``native`` for a document without objects. ``rejects``: the documents that are not well-formed annotations.
    """
    others = [c for c in documents.columns if c != xml]
    # A document that does not parse is null, or has neither a file name nor a size.
    parsed = documents.withColumn("_a", F.from_xml(F.col(xml), VOC_SCHEMA, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("_a.filename").isNotNull() | F.col("_a.size").isNotNull(), F.lit(False)) & F.col(xml).rlike(r"</annotation>\s*$")
    rows = parsed.where(good).select(*others, F.col("_a.filename").alias("filename"), F.col("_a.size.width").alias("width"), F.col("_a.size.height").alias("height"), F.explode_outer("_a.object").alias("o"))
    objects = rows.select(*others, "filename", "width", "height", F.col("o.name").alias("native"), *(F.col(f"o.bndbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    return objects, parsed.where(~good).select(*documents.columns)


def read_voc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``voc_objects`` of all XML files below a folder, with ``path`` and ``stem``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").option("wholetext", True).text(path)
    return voc_objects(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")).withColumn("stem", stem_of(F.col("path"))))


def folder_classes(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` and ``native, stem``: the folder is the class, the box the whole picture, the stem ``<folder>__<name>``."""
    parts = F.split(path, "/")
    native = F.element_at(parts, -2)
    return files.where(F.size(parts) >= 2).withColumn("native", native).withColumn("stem", F.concat_ws("__", native, stem_of(F.col(path))))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of all files below a folder, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length")


def polygon_to_label(coords: Column) -> Column:
    """The normalized box of a label's coordinates."""
    return yolo_shape(coords)


def label_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """A label line with six decimals. Halves are rounded up, where C's printf would take the even digit."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, cx, cy, w, h)


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as Parquet by split; each run replaces what was there."""
    labels.write.mode("overwrite").partitionBy("split").parquet(path)
