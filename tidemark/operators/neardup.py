"""Near-duplicate removal over perceptual hashes.

Items of one hash are compared once: a group of exact copies is one vertex, led by its
first item, and only distinct hashes are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bits
from tidemark.operators.graph import components
from tidemark.operators.hamming import hamming_join
from tidemark.operators.ranking import hashed_rank
from tidemark.session import Scratch

BANDS = 8


def banded_pairs(left: DataFrame, right: DataFrame | None = None, threshold: int = 3) -> DataFrame:
    """``hash_a, hash_b, dist`` within the threshold that share at least one of eight byte bands.

    Up to 7 bits every pair shares a band, so the exact join serves; beyond, sharing a
    band is part of the meaning and the bands themselves are joined.
    """
    if threshold < BANDS:
        return hamming_join(left, right, threshold)
    spread = lambda h, n: h.select(F.col("hash").alias(n), F.posexplode(F.array(*(bits.band(F.col("hash"), i) for i in range(BANDS)))).alias("at", "band"))
    pairs = spread(left, "hash_a").join(spread(right if right is not None else left, "hash_b"), ["at", "band"])
    dist = bits.hamming(F.col("hash_a"), F.col("hash_b"))
    kept = pairs.where(dist <= threshold)
    if right is None:
        kept = kept.where(F.col("hash_a") < F.col("hash_b"))
    return kept.select("hash_a", "hash_b", dist.alias("dist")).distinct()


def priority(military: Column, boxes: Column, stem: Column, item: Column) -> Column:
    """The order in which items are kept: military ones, more boxes, then the stem."""
    return F.struct((~F.coalesce(military, F.lit(False))).alias("civil"), (-F.coalesce(boxes, F.lit(0))).alias("fewer"), stem.alias("stem"), item.alias("item"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("hash_a").alias("hash"), F.col("hash_b").alias("other"), "dist").unionAll(
        pairs.select(F.col("hash_b").alias("hash"), F.col("hash_a").alias("other"), "dist")
    )


def greedy_dedup(items: DataFrame, threshold: int = 3) -> DataFrame:
    """``item_id, kept, rep_id, dist`` of every item (``item_id, hash, turn``).

    In the order of ``turn`` an item is kept unless a kept one before it is within the
    threshold. A dropped item has the nearest such item as ``rep_id``, ties to the earlier;
    a kept one has null. Items without a real hash are all kept. The result equals the one-by-one
    procedure; each round settles every hash that leads all its undecided neighbours.
    """
    scratch = Scratch(items.sparkSession, "greedy")
    rows = scratch.save(items.select("item_id", bits.real(F.col("hash")).alias("hash"), "turn"), "items")
    leads = scratch.save(rows.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.min("turn").alias("turn")), "leads")
    near = scratch.save(_both(banded_pairs(leads.select("hash"), threshold=threshold)), "near")
    waiting, kept = leads, []
    while not waiting.isEmpty():
        rival = near.join(waiting.select(F.col("hash").alias("other"), F.col("turn").alias("rival")), "other").groupBy("hash").agg(F.min("rival").alias("rival"))
        first = waiting.join(rival, "hash", "left").where(F.coalesce(F.col("turn") < F.col("rival"), F.lit(True)))
        taken = scratch.save(first.select("hash", "turn"), "taken")
        kept.append(taken)
        beside = near.join(taken.select(F.col("hash").alias("other")), "other", "left_semi").select("hash")
        rest = waiting.join(taken.select("hash").unionAll(beside), "hash", "left_anti")
        waiting = scratch.save(rest, "waiting")
    winners = kept[0] if kept else leads
    for more in kept[1:]:
        winners = winners.unionAll(more)
    winners = scratch.save(winners, "winners")
    own = winners.select("hash", F.col("turn").alias("rep"), F.lit(0).alias("dist"))
    others = near.join(winners.select(F.col("hash").alias("other"), F.col("turn").alias("rep")), "other").select("hash", "rep", "dist")
    beaten = (
        rows.join(own.unionAll(others), "hash")
        .where(F.col("rep") < F.col("turn"))
        .groupBy("item_id")
        .agg(F.min(F.struct("dist", "rep")).alias("best"))
        .select("item_id", F.col("best.rep.item").alias("rep_id"), F.col("best.dist").alias("dist"))
    )
    return scratch.finish(rows.select("item_id").join(beaten, "item_id", "left").select("item_id", F.col("rep_id").isNull().alias("kept"), "rep_id", "dist"))


def single_linkage(items: DataFrame, threshold: int = 3) -> DataFrame:
    """``item_id, cluster_id, rep_id`` of the items in clusters of two or more.

    Clusters chain over near pairs. The representative has most boxes, then is military, then has the
    last stem. ``items``: ``item_id, hash, num_boxes, military, stem``.
    """
    scratch = Scratch(items.sparkSession, "linkage")
    rows = scratch.save(items.withColumn("hash", bits.real(F.col("hash"))).where(F.col("hash").isNotNull()), "items")
    hubs = scratch.save(rows.groupBy("hash").agg(F.min("item_id").alias("hub")), "hubs")
    pairs = hamming_join(hubs.select("hash"), threshold=threshold)
    across = pairs.join(hubs.select(F.col("hash").alias("hash_a"), F.col("hub").alias("src")), "hash_a").join(hubs.select(F.col("hash").alias("hash_b"), F.col("hub").alias("dst")), "hash_b")
    copies = rows.join(hubs, "hash").select(F.col("hub").alias("src"), F.col("item_id").alias("dst"))
    members = scratch.save(components(scratch, across.select("src", "dst").unionAll(copies)), "members")
    held = members.join(rows, members["node"] == rows["item_id"])
    best = F.max(F.struct(F.coalesce("num_boxes", F.lit(0)), F.coalesce("military", F.lit(False)), "stem", "item_id"))["item_id"]
    named = held.groupBy("component").agg(F.min("item_id").alias("cluster_id"), best.alias("rep_id"))
    return scratch.finish(members.join(named, "component").select(F.col("node").alias("item_id"), "cluster_id", "rep_id"))


def audit_totals(drops: DataFrame) -> DataFrame:
    """One row of totals over ``item_id, rep_id, dist, military, rep_military`` of dropped items."""
    groups = drops.groupBy("rep_id").agg(F.count("*").alias("n"))
    sized = groups.agg(
        F.count("*").alias("groups"), F.coalesce(F.max(F.col("n") + 1), F.lit(0)).alias("largest"), F.round(F.avg(F.col("n") + 1), 6).alias("mean_size"),
        F.coalesce(F.sum(F.when(F.col("n") + 1 > 10, F.col("n"))), F.lit(0)).alias("drops_in_large"),
    )
    either = F.coalesce(F.col("military"), F.lit(False)) | F.coalesce(F.col("rep_military"), F.lit(False))
    totals = drops.agg(F.count("*").alias("dropped"), F.count_if(either).alias("military_pairs"), F.count_if(F.col("dist") == 0).alias("exact"))
    share = F.coalesce(F.round(F.try_divide(F.col("military_pairs") * 100.0, F.col("dropped")), 6), F.lit(0.0))
    # Two single rows side by side, joined on a constant.
    return sized.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one").withColumn("military_percent", share).drop("one")


def audit_sample(drops: DataFrame, size: int = 40, far: int = 5) -> DataFrame:
    """``item_id, rep_id, dist`` of drops to look at: ``size`` at even steps through the drops in the order of their distance, and
    the ``far`` farthest that involve a military item.

    Drops of one distance are in the order of an md5 of their item. Few distances occur, so places are
    counted within each and moved up by the drops of smaller ones. ``drops`` as for ``audit_totals``.
    """
    scratch = Scratch(drops.sparkSession, "audit")
    rows = scratch.save(drops, "drops")
    step = rows.agg((F.count("*") / float(size)).alias("step"))
    picks = step.select(F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"), "step").select((F.floor(F.col("j") * F.col("step")) + 1).alias("at")).distinct()
    nearer = Window.orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("dist").agg(F.count("*").alias("n")).select("dist", F.coalesce(F.sum("n").over(nearer), F.lit(0)).alias("before"))
    placed = hashed_rank(rows, ["dist"], F.md5(F.col("item_id").cast("string")), "item_id").join(offsets, "dist").withColumn("at", F.col("before") + F.col("place"))
    even = placed.join(picks, "at", "left_semi").select("item_id", "rep_id", "dist")
    military = rows.where(F.coalesce(F.col("military"), F.lit(False)) | F.coalesce(F.col("rep_military"), F.lit(False)))
    return scratch.finish(even.unionAll(military.orderBy(F.desc("dist"), "item_id").limit(far).select("item_id", "rep_id", "dist")).distinct())


def reject_near(candidates: DataFrame, holdout: DataFrame, threshold: int = 5) -> DataFrame:
    """The rows of ``candidates`` whose hash is within the threshold of no hash of ``holdout``.

    The guard against leaks is wider than near-duplicate removal: five bits, all of them found.
    """
    distinct = lambda t: t.select(bits.real(F.col("hash")).alias("hash")).where(F.col("hash").isNotNull()).distinct()
    near = hamming_join(distinct(candidates), distinct(holdout), threshold).select(F.col("hash_a").alias("hash")).distinct()
    return candidates.join(near, "hash", "left_anti").select(*candidates.columns)
