"""Row numbers within groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_rank(rows: DataFrame, group: list[str], draw: Column, tie: str, name: str = "place", buckets: int = 1024) -> DataFrame:
    """``rows`` with a 1-based place inside each group in the order of a hexadecimal draw.

    ``draw`` is a uniform hexadecimal text such as md5. Places are counted over its leading
    digits first, a table of ``buckets`` rows a group, and then inside each
    bucket, so no task sorts a whole group. Equal draws follow ``tie``.
    """
    drawn = rows.withColumn("_draw", draw).withColumn("_bucket", (F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("int"))
    held = drawn.groupBy(*group, "_bucket").agg(F.count("*").alias("_held"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*group, "_bucket", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_draw", tie)
    named = offsets.select(*(F.col(c).alias(f"_of_{c}") for c in [*group, "_bucket"]), "_before")
    ranked = drawn.withColumn("_inside", F.row_number().over(inside))
    # Null-safe, as a group may have a null.
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_bucket"]]
    return ranked.join(named, same).withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).select(*rows.columns, name)
