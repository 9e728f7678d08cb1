"""From native class names to the taxonomy, and what a conversion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "*"


def resolve(annotations: DataFrame, mappings: DataFrame, classes: DataFrame) -> DataFrame:
    """``annotations`` (with ``dataset, native``) and ``class_id, reason``.

    A row of ``mappings`` (dataset, native, target) names the class of a native name; a null target
    drops it; the native name ``*`` stands for all names not listed. ``reason`` is ``mapped``, ``dropped``
    or ``unmapped``. Mappings and taxonomy are configuration; the planner broadcasts them by their size.
    """
    named = mappings.join(classes.select(F.col("name").alias("target"), "class_id"), "target", "left").withColumn("hit", F.lit(True))
    exact = named.where(F.col("native") != WILDCARD).select("dataset", "native", F.col("hit").alias("hit_e"), F.col("class_id").alias("class_e"))
    rest = named.where(F.col("native") == WILDCARD).select("dataset", F.col("hit").alias("hit_w"), F.col("class_id").alias("class_w"))
    joined = annotations.join(exact, ["dataset", "native"], "left").join(rest, "dataset", "left")
    found = F.when(F.col("hit_e"), F.col("class_e")).otherwise(F.col("class_w"))
    listed = F.coalesce(F.col("hit_e"), F.col("hit_w"), F.lit(False))
    reason = F.when(~listed, "unmapped").when(found.isNull(), "dropped").otherwise("mapped")
    return joined.withColumn("reason", reason).withColumn("class_id", found).drop("hit_e", "class_e", "hit_w", "class_w")


def mapping_problems(mappings: DataFrame, classes: DataFrame) -> DataFrame:
    """``dataset, native, target`` of the mappings whose target is no class."""
    known = classes.select(F.col("name").alias("target"))
    return mappings.where(F.col("target").isNotNull()).join(known, "target", "left_anti").select("dataset", "native", "target")


def conversion_counts(resolved: DataFrame, kept: Column) -> DataFrame:
    """``dataset, native, seen, mapped, dropped, unmapped, written, degenerate`` by native name.

    ``kept`` tells whether the geometry of a mapped row survives; reasons are counted before geometry.
    """
    mapped = F.col("reason") == "mapped"
    return resolved.groupBy("dataset", "native").agg(
        F.count("*").alias("seen"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in ("mapped", "dropped", "unmapped")),
        F.count_if(mapped & kept).alias("written"),
        F.count_if(mapped & ~kept).alias("degenerate"),
    )


def class_groups(classes: DataFrame, groups: DataFrame, precedence: tuple[str, ...] = ("military", "small_craft", "civilian")) -> DataFrame:
    """``class_id, name, group``: one group for each class, the first by precedence, then by name; ``other`` without any."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in precedence)), F.col("group")), F.lit(0))
    ranked = groups.withColumn("place", F.when(place == 0, len(precedence) + 1).otherwise(place))
    best = ranked.groupBy("class_id").agg(F.min(F.struct("place", "group"))["group"].alias("group"))
    return classes.join(best, "class_id", "left").select("class_id", "name", F.coalesce("group", F.lit("other")).alias("group"))


def with_domain(items: DataFrame, domains: DataFrame, default: str = "surface") -> DataFrame:
    """``items`` with ``domain``: their own unless it is missing, then their dataset's, then ``default``."""
    from tidemark.functions import text

    home = domains.select(text.word(F.col("dataset")).alias("_dataset"), F.col("domain").alias("_home"))
    own = text.present(F.col("domain"), text.word(F.col("domain")))
    joined = items.withColumn("_dataset", text.word(F.col("dataset"))).join(home, "_dataset", "left")
    return joined.withColumn("domain", F.coalesce(own, "_home", F.lit(default))).drop("_dataset", "_home")
