"""Names without collisions, and first-wins choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import hashed_rank

# Picture extensions in the order in which they are looked for.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def first_by(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row for each key, the first in the order; a fold that combines before it shuffles."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*key, *(F.col("_best")[c].alias(c) for c in rest))


def image_for_stem(files: DataFrame) -> DataFrame:
    """``stem, ext, path`` of the file of each stem whose extension comes first; ``files``: ``stem, ext, path``, case ignored."""
    listed = F.array(*(F.lit(e) for e in EXTENSIONS))
    known = files.withColumn("ext", F.lower("ext")).where(F.col("ext").isin(*EXTENSIONS))
    return first_by(known, ["stem"], F.struct(F.array_position(listed, F.col("ext")), F.col("path")))


def unique_stems(rows: DataFrame) -> DataFrame:
    """``id, stem, unique_stem`` of ``rows`` (``id, stem``): the first of a stem by hashed order keeps it, others get ``_k``.

    The suffix numbers that would give a stem already present are passed over, so the result has no
    repeats whatever the order of the input.
    """
    ranked = hashed_rank(rows.select("id", "stem"), ["stem"], F.md5(F.col("id").cast("string")), "id")
    # Only a stem of the form base_k can be met by a generated name.
    base, k = F.regexp_extract("stem", r"^(.*)_([0-9]+)$", 1), F.regexp_extract("stem", r"^(.*)_([0-9]+)$", 2)
    taken = rows.select("stem").distinct().where(F.col("stem").rlike(r"_([1-9][0-9]{0,8})$")).select(base.alias("stem"), k.cast("bigint").alias("k"))
    repeated = rows.groupBy("stem").count().where("count > 1").select("stem")
    held = taken.join(repeated, "stem", "left_semi").groupBy("stem").agg(F.array_sort(F.collect_set("k")).alias("held"))
    joined = ranked.join(held, "stem", "left")
    start = F.col("place") - 1
    shifted = F.aggregate(F.coalesce("held", F.array().cast("array<bigint>")), start, lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return joined.select("id", "stem", F.when(start == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", shifted.cast("string"))).alias("unique_stem"))
