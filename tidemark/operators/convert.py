"""From a source's own YOLO labels to those of the taxonomy, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators.mapping import resolve
from tidemark.operators.naming import image_for_stem
from tidemark.sources.labels import list_files, stem_of, yolo

KEY = ["root", "stem"]


def source_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(files, lines, images)`` of every ``labels`` folder below ``path`` and the ``images`` folder beside it.

    ``root`` is the folder that holds the two. ``files``: ``root, stem`` of the label files; ``lines`` also ``line``, without blank
    ones; ``images``: ``root, stem, ext, path``. Files of no bytes are passed over by the reader.
    """
    parent = lambda folder: F.regexp_extract("path", rf"^(.*)/{folder}/[^/]+$", 1)
    listed = list_files(spark, path).select("path").withColumn("stem", stem_of(F.col("path")))
    files = listed.where(F.col("path").rlike(r"/labels/[^/]+\.txt$")).select(parent("labels").alias("root"), "stem")
    images = listed.where(F.col("path").rlike(r"/images/[^/]+\.[^/.]+$")).select(parent("images").alias("root"), "stem", F.regexp_extract("path", r"\.([^/.]+)$", 1).alias("ext"), "path")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    inside = text.where(F.col("path").rlike(r"/labels/[^/]+\.txt$") & (F.col("line") != "")).withColumn("stem", stem_of(F.col("path")))
    same_form = F.regexp_replace("root", "^file:/+", "/")
    of_root = lambda table: table.withColumn("root", same_form)
    return of_root(files), of_root(inside.select(parent("labels").alias("root"), "stem", "line")), of_root(images)


def convert_yolo(files: DataFrame, lines: DataFrame, images: DataFrame, names: list[str], dataset: str, mappings: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(labels, counts)`` of a source whose class ids stand for ``names``.

    ``labels``: ``root, stem, path, class_id, cx, cy, w, h`` of the lines that survive; an image without any is left out. ``counts``: ``part, outcome, n``.
    A line ends as ``bad_line`` (its id is no number), ``out_of_range``, ``unmapped`` or ``dropped`` by the taxonomy, ``malformed`` (its coordinates
    are none), ``degenerate`` (a polygon without area) or ``written``; a label file as ``no_image``, ``no_labels`` or ``written``. Lines of files without
    an image are not looked at. Mappings without a row of this dataset are an error.
    """
    if mappings.where(F.col("dataset") == dataset).isEmpty():
        raise ValueError(f"no mappings for the dataset {dataset}")
    spark = lines.sparkSession
    beside = image_for_stem(images.select(F.struct("root", "stem").alias("stem"), "ext", "path")).select("stem.root", "stem.stem", "path")
    pictured = files.select(*KEY).distinct().join(beside, KEY, "left")
    parsed = yolo(lines).join(pictured.where(F.col("path").isNotNull()), KEY)
    named = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "source_id int, native string")
    source_id = scalars.class_id(F.get(scalars.tokens(F.col("line")), F.lit(0)))
    told = parsed.withColumn("source_id", source_id).join(named, "source_id", "left").withColumn("dataset", F.lit(dataset)).drop("class_id")
    judged = resolve(told, mappings, classes)
    polygon = F.size(scalars.tokens(F.col("line"))) > 5
    outcome = (
        F.when(F.col("source_id").isNull(), "bad_line").when(F.col("native").isNull(), "out_of_range").when(F.col("reason") != "mapped", F.col("reason"))
        .when(F.col("cx").isNull(), "malformed").when(polygon & ((F.col("w") <= 0) | (F.col("h") <= 0)), "degenerate").otherwise("written")
    )
    judged = judged.withColumn("outcome", outcome)
    labels = judged.where(F.col("outcome") == "written").select(*KEY, "path", "class_id", "cx", "cy", "w", "h")
    kept = labels.select(*KEY).distinct().withColumn("kept", F.lit(True))
    end = F.when(F.col("path").isNull(), "no_image").when(F.col("kept"), "written").otherwise("no_labels")
    per_file = pictured.join(kept, KEY, "left").groupBy(F.lit("file").alias("part"), end.alias("outcome")).agg(F.count("*").alias("n"))
    per_line = judged.groupBy(F.lit("line").alias("part"), "outcome").agg(F.count("*").alias("n"))
    return labels, per_file.unionAll(per_line)


def collect_items(files: DataFrame, lines: DataFrame, images: DataFrame, domains: DataFrame, default: str) -> tuple[DataFrame, DataFrame]:
    """``(items, outcomes)`` of an interim tree, whose roots are one folder a dataset, as ``source_tree`` reads it.

    ``items``: ``dataset, domain, stem, path, classes, num_boxes`` of every label file with an image and at least one line; the stem is
    ``<dataset>__<name>``, the domain that of ``domains`` (``dataset, domain``) or ``default``. ``outcomes``: ``dataset, outcome, n`` of the label files: ``collected``,
    ``no_image`` or ``empty_label``; a dataset with images alone has one ``no_labels``.
    """
    dataset = F.element_at(F.split("root", "/"), -1)
    beside = image_for_stem(images.select(F.struct("root", "stem").alias("stem"), "ext", "path")).select("stem.root", "stem.stem", "path")
    held = yolo(lines).groupBy(*KEY).agg(F.array_sort(F.collect_set("class_id")).alias("classes"), F.count("*").alias("num_boxes"))
    told = files.select(*KEY).distinct().join(beside, KEY, "left").join(held, KEY, "left").withColumn("dataset", dataset)
    end = F.when(F.col("path").isNull(), "no_image").when(F.col("num_boxes").isNull(), "empty_label").otherwise("collected")
    judged = told.withColumn("outcome", end)
    homes = domains.groupBy("dataset").agg(F.min("domain").alias("domain"))
    placed = judged.where(F.col("outcome") == "collected").join(homes, "dataset", "left")
    items = placed.select("dataset", F.coalesce("domain", F.lit(default)).alias("domain"), F.concat_ws("__", "dataset", "stem").alias("stem"), "path", "classes", "num_boxes")
    bare = images.select("root").distinct().join(files.select("root").distinct(), "root", "left_anti").select(dataset.alias("dataset"), F.lit("no_labels").alias("outcome"), F.lit(1).cast("bigint").alias("n"))
    return items, judged.groupBy("dataset", "outcome").agg(F.count("*").alias("n")).unionAll(bare)
