"""Splits that keep related records together.

Two items are related if they share a scene, a collector or an image. Items are the
vertices; each shared key gives star edges to its smallest item, and each pair of
near hashes one edge between the smallest items of the two hashes, so the
graph has at most four edges to an item and one to a near pair of distinct hashes,
however many items share a key.

Components come from a frontier breadth-first search. At each level the seeds are the
vertices that outrank all their neighbours by (degree, hash); all seeds expand
at once over the adjacency table, written in buckets by the hash of the source, until every vertex has the
label of a seed; labels that touch make the edges of a smaller graph, which is
treated the same way. A hub outranks its leaves, so a star takes one level and one
round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.llm.images import records
from tidemark.operators.graph import Adjacency, components, hubs_of, salted_join
from tidemark.operators.hamming import cheapest_agree, hamming_join
from tidemark.session import Scratch

SPLITS = (("train", 0.7), ("val", 0.2), ("test", 0.1))


def frontier_clusters(scratch: Scratch, edges: DataFrame, level: int, hubs: DataFrame | None = None) -> DataFrame:
    """The contraction rule: breadth-first search from many seeds at once."""
    adjacency = Adjacency(scratch, edges, hubs)
    # Degree first, then a draw; of two neighbours that are equal in both, both are seeds, and their labels meet.
    drawn = F.shiftleft(F.col("degree"), 24).bitwiseOR(F.xxhash64("node", F.lit(level)).bitwiseAND(F.lit((1 << 24) - 1)))
    degree = adjacency.table.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    ranked = scratch.save(degree.select("node", drawn.alias("rank")), "ranks")
    highest = adjacency.reached(ranked.select("node", F.col("rank").alias("near"))).groupBy("node").agg(F.max("near").alias("near"))
    seeds = highest.join(ranked, "node").where(F.col("rank") >= F.col("near"))
    frontier = scratch.save(seeds.select("node", F.col("node").alias("label")), "frontier")
    rounds = [frontier]
    while not frontier.isEmpty():
        met = adjacency.reached(frontier).groupBy("node").agg(F.min("label").alias("label"))
        # A vertex next to round r was first met in round r - 1, r or r + 1.
        for seen in rounds[-2:]:
            met = met.join(seen.select("node"), "node", "left_anti")
        frontier = scratch.save(met, "frontier")
        rounds.append(frontier)
    labels = rounds[0]
    for more in rounds[1:]:
        labels = labels.unionAll(more)
    return labels


def _shared_keys(items: DataFrame) -> DataFrame:
    """``kind, key, hub, near`` rows: each item under its keys that at least one other item has."""
    keys = F.array(
        *(F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("key")) for kind, column in (("scene", "scene"), ("collector", "collector"), ("stem", "stem_key"), ("hash", "real_hash")))
    )
    return items.select("id", F.explode(keys).alias("k")).select("id", "k.kind", "k.key").where(F.col("key").isNotNull())


def relations(scratch: Scratch, items: DataFrame, threshold: int = 3) -> DataFrame:
    """``src, dst`` edges between related items."""
    keyed = scratch.save(_shared_keys(items), "keys")
    hubs = scratch.save(keyed.groupBy("kind", "key").agg(F.min("id").alias("hub"), F.count("*").alias("size")), "hubs")
    shared = hubs.where(F.col("size") > 1)
    stars = keyed.join(shared, ["kind", "key"]).where(F.col("id") != F.col("hub")).select(F.col("hub").alias("src"), F.col("id").alias("dst"))
    of_hash = hubs.where(F.col("kind") == "hash").select(F.col("key").cast("bigint").alias("hash"), "hub")
    near = hamming_join(of_hash.select("hash"), threshold=threshold, agree=cheapest_agree(of_hash.count(), threshold))
    a = of_hash.select(F.col("hash").alias("hash_a"), F.col("hub").alias("src"))
    b = of_hash.select(F.col("hash").alias("hash_b"), F.col("hub").alias("dst"))
    return stars.unionAll(near.join(a, "hash_a").join(b, "hash_b").select("src", "dst"))


def related_groups(scratch: Scratch, items: DataFrame, threshold: int = 3) -> DataFrame:
    """``id, component`` of every item with at least one relation."""
    grouped = components(scratch, relations(scratch, items, threshold), frontier_clusters)
    return grouped.select(F.col("node").alias("id"), "component")


def _prepared(table: DataFrame) -> DataFrame:
    return records(
        table,
        "item_id",
        text.key(F.col("scene_key")).alias("scene"),
        text.key(F.col("collected_by")).alias("collector"),
        text.assigned(F.col("split")).alias("given"),
    )


def divided_groups(table: DataFrame, threshold: int = 3) -> DataFrame:
    """``item_id`` of every item whose group has members in more than one assigned split.

    Unassigned members of such a group are included. Items related to none are never
    divided. Null and placeholder keys, stems and hashes relate nothing.
    """
    scratch = Scratch(table.sparkSession, "related")
    items = scratch.save(_prepared(table), "items")
    groups = scratch.save(related_groups(scratch, items.drop("given"), threshold), "groups")
    spread = (
        groups.join(items.select("id", "given"), "id")
        .groupBy("component")
        .agg(F.min("given").alias("low"), F.max("given").alias("high"))
        .where(F.col("low") != F.col("high"))
    )
    sizes = groups.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("n"))
    divided = salted_join(groups, spread.select("component"), "component", hubs_of(scratch, sizes))
    return scratch.finish(divided.select(F.col("id").alias("item_id")))


def _by_hash_order(position: Column, total: Column, splits: tuple[tuple[str, float], ...]) -> Column:
    """The split in whose stretch of the row the middle of a component falls."""
    edge, chosen = 0.0, F.lit(splits[-1][0])
    ends = []
    for name, share in splits:
        edge += share
        ends.append((name, edge))
    for name, end in reversed(ends[:-1]):
        chosen = F.when(position < total * end, name).otherwise(chosen)
    return chosen


def assign_splits(
    table: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, seed: int = 42, threshold: int = 3, buckets: int = 4096
) -> DataFrame:
    """``item_id, group_id, new_split``: whole groups dealt to splits in the given proportions.

    Components stand in a row in the order of a seeded hash and each goes to the split
    in whose stretch its middle item lies. The running count is taken over hash
    buckets first (a table of ``buckets`` rows) and then within each bucket,
    so that no task sorts all components. Shares differ from the targets by at most the
    size of the component across a boundary. An item related to none is a group of
    its own; ``group_id`` is the smallest item id. An empty table gives an empty result.
    """
    if not math.isclose(sum(share for _, share in splits), 1.0):
        raise ValueError("the shares of the splits must sum to 1")
    scratch = Scratch(table.sparkSession, "splits")
    items = scratch.save(_prepared(table).drop("given"), "items")
    groups = scratch.save(related_groups(scratch, items, threshold), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("group_id"))
    alone = items.join(groups, "id", "left_anti").select(F.col("id").alias("component"), F.lit(1).cast("bigint").alias("size"), F.col("id").alias("group_id"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group_id")))
    placed = scratch.save(
        sizes.unionAll(alone).withColumn("draw", drawn).withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / 2**32 * buckets)), "placed"
    )
    per_bucket = placed.groupBy("bucket").agg(F.sum("size").alias("held"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "bucket", F.coalesce(F.sum("held").over(running), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy()).alias("total")
    )
    inside = Window.partitionBy("bucket").orderBy("draw", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    dealt = placed.join(F.broadcast(offsets), "bucket").select("component", "group_id", _by_hash_order(middle, F.col("total"), splits).alias("new_split"))
    whole = items.select("id").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    hubs = hubs_of(scratch, placed.select(F.col("component").alias("node"), F.col("size").alias("n")))
    return scratch.finish(salted_join(whole, dealt, "component", hubs).select(F.col("id").alias("item_id"), "group_id", "new_split"))
