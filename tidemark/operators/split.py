"""Stratified splits and the distributions that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import hashed_rank

SPLITS = ("train", "val", "test")


def rarest_class(items: DataFrame) -> DataFrame:
    """``item_id, class_id``: the class of each item that the fewest items have, ties to the smaller id; -1 without classes."""
    each = items.select("item_id", F.explode(F.array_distinct("classes")).alias("class_id")).where(F.col("class_id").isNotNull())
    held = each.groupBy("class_id").agg(F.count("*").alias("n"))
    best = each.join(held, "class_id").groupBy("item_id").agg(F.min(F.struct("n", "class_id"))["class_id"].alias("class_id"))
    return items.select("item_id").join(best, "item_id", "left").select("item_id", F.coalesce("class_id", F.lit(-1)).alias("class_id"))


def largest_remainder(n: Column, val: float, test: float) -> Column:
    """A struct ``train, val, test`` of whole counts that sum to ``n``; left-over ones go to the largest fractions, ties in this order."""
    shares = [1.0 - val - test, val, test]
    exact = [n * F.lit(s) for s in shares]
    base = [F.floor(e).cast("bigint") for e in exact]
    rest = n - base[0] - base[1] - base[2]
    ahead = []
    for k in range(3):
        frac = exact[k] - base[k]
        before = [(exact[j] - base[j] >= frac) if j < k else (exact[j] - base[j] > frac) for j in range(3) if j != k]
        ahead.append(sum((b.cast("int") for b in before), F.lit(0)))
    return F.struct(*((base[k] + (ahead[k] < rest).cast("bigint")).alias(SPLITS[k]) for k in range(3)))


def stratified_split(items: DataFrame, val: float = 0.2, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``item_id, domain, class_id, split`` of ``items`` (``item_id, stem, domain, classes``).

    Strata are domain by rarest class; inside one the order is that of md5(seed and stem), and the
    first items are train, the next val, the last test, in the counts of ``largest_remainder``.
    """
    strata = items.select("item_id", "stem", "domain").join(rarest_class(items), "item_id")
    ranked = hashed_rank(strata, ["domain", "class_id"], F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("stem", F.lit("")))), "item_id")
    sizes = strata.groupBy("domain", "class_id").agg(F.count("*").alias("n")).withColumn("cut", largest_remainder(F.col("n"), val, test))
    # Groups are compared null-safe: an unknown domain is a stratum too.
    joined = ranked.alias("r").join(sizes.alias("s"), F.col("r.domain").eqNullSafe(F.col("s.domain")) & (F.col("r.class_id") == F.col("s.class_id")))
    split = F.when(F.col("place") <= F.col("cut.train"), "train").when(F.col("place") <= F.col("cut.train") + F.col("cut.val"), "val").otherwise("test")
    return joined.select("r.item_id", "r.domain", "r.class_id", split.alias("split"))


def by_split(rows: DataFrame, key: str) -> DataFrame:
    """``key, train, val, test``: counts of rows."""
    return rows.groupBy(key).agg(*(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))


def class_by_split(items: DataFrame, classes: DataFrame) -> DataFrame:
    """``class_id, name, train, val, test`` in items, classes without any included."""
    each = items.select("split", F.explode(F.array_distinct("classes")).alias("class_id"))
    return classes.join(by_split(each, "class_id"), "class_id", "left").select("class_id", "name", *(F.coalesce(s, F.lit(0)).alias(s) for s in SPLITS))


def domain_by_class(items: DataFrame) -> DataFrame:
    """``domain, class_id, n`` with the totals of rows and columns, null standing for all (and ``level`` for which)."""
    each = items.select("domain", F.explode(F.array_distinct("classes")).alias("class_id"))
    return each.cube("domain", "class_id").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def manifest(items: DataFrame) -> DataFrame:
    """``split, domain, dataset, stem, num_boxes, classes`` with the class ids joined by bars."""
    ids = F.transform(F.array_sort(F.array_distinct("classes")), lambda c: c.cast("string"))
    return items.select("split", "domain", "dataset", "stem", "num_boxes", F.coalesce(F.concat_ws("|", ids), F.lit("")).alias("classes"))
