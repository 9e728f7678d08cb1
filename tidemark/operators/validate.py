"""Rules of a finished dataset: label lines, orphans, splits and leakage between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bits, scalars
from tidemark.operators.hamming import hamming_join


def line_violations(lines: DataFrame, num_classes: int, text: str = "line") -> DataFrame:
    """``lines`` with ``rule``, a row for every rule a label line breaks; blank lines break none.

    ``fields``: not five. ``numeric``: a field is no number. Only lines past these two are
    tested for ``class_range``, ``coord_range`` (once for each coordinate) and ``size``.
    """
    parts = scalars.tokens(F.col(text))
    rows = lines.withColumn("_t", parts).where(F.size("_t") > 0)
    rows = rows.withColumn("_n", F.transform("_t", scalars.number)).withColumn("_c", scalars.class_id(F.get("_t", F.lit(0))))
    five = F.size("_t") == 5
    numeric = F.forall("_n", lambda v: v.isNotNull()) & F.col("_c").isNotNull()
    n = lambda k: F.get("_n", F.lit(k))
    broken = F.array(
        F.when(~five, "fields"),
        F.when(five & ~numeric, "numeric"),
        F.when(five & numeric & ~F.col("_c").between(0, num_classes - 1), "class_range"),
        *(F.when(five & numeric & ~n(k).between(0, 1), "coord_range") for k in (1, 2, 3, 4)),
        F.when(five & numeric & ((n(3) <= 0) | (n(4) <= 0)), "size"),
    )
    return rows.withColumn("rule", F.explode(F.array_compact(broken))).drop("_t", "_n", "_c")


def orphans(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``split, stem, rule`` of images without a label and labels without an image."""
    on = ["split", "stem"]
    i, lab = images.select(*on).distinct(), labels.select(*on).distinct()
    return i.join(lab, on, "left_anti").withColumn("rule", F.lit("image_without_label")).unionAll(lab.join(i, on, "left_anti").withColumn("rule", F.lit("label_without_image")))


def missing_splits(images: DataFrame, wanted: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """``split`` of the wanted ones that hold nothing."""
    names = images.sparkSession.createDataFrame([(w,) for w in wanted], "split string")
    return names.join(images.select("split").distinct(), "split", "left_anti")


def leakage(items: DataFrame, threshold: int = 3) -> DataFrame:
    """``split_a, split_b, same_stem, near_hash``: for each pair of splits the stems in both, and the near pairs of distinct hashes.

    ``items``: ``split, stem, hash``. A split comes before another by name. Members of a
    group of copies are not paired; a hash in both splits is one pair.
    """
    held = items.where(F.col("split").isNotNull())
    side = lambda c, s: held.where(F.col(c).isNotNull()).select(c, F.col("split").alias(s)).distinct()
    stems = side("stem", "split_a").join(side("stem", "split_b"), "stem").where(F.col("split_a") < F.col("split_b"))
    by_stem = stems.groupBy("split_a", "split_b").agg(F.count("*").alias("same_stem"))
    real = held.withColumn("hash", bits.real(F.col("hash"))).where(F.col("hash").isNotNull())
    own = real.select("hash", "split").distinct()
    pairs = hamming_join(own.select("hash").distinct(), threshold=threshold)
    both = pairs.select("hash_a", "hash_b").unionAll(pairs.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b"))).unionAll(
        own.select("hash").distinct().select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"))
    )
    a, b = own.select(F.col("hash").alias("hash_a"), F.col("split").alias("split_a")), own.select(F.col("hash").alias("hash_b"), F.col("split").alias("split_b"))
    across = both.join(a, "hash_a").join(b, "hash_b").where(F.col("split_a") < F.col("split_b"))
    by_hash = across.groupBy("split_a", "split_b").agg(F.count("*").alias("near_hash"))
    joined = by_stem.join(by_hash, ["split_a", "split_b"], "full")
    return joined.select("split_a", "split_b", F.coalesce("same_stem", F.lit(0)).alias("same_stem"), F.coalesce("near_hash", F.lit(0)).alias("near_hash"))


def report(lines: DataFrame, num_classes: int, text: str = "line") -> DataFrame:
    """``boxes, errors, ok``: non-blank lines, broken rules, and whether there are none."""
    boxes = lines.where(F.size(scalars.tokens(F.col(text))) > 0).agg(F.count("*").alias("boxes")).withColumn("one", F.lit(1))
    errors = line_violations(lines, num_classes, text).agg(F.count("*").alias("errors")).withColumn("one", F.lit(1))
    return boxes.join(errors, "one").select("boxes", "errors", (F.col("errors") == 0).alias("ok"))
