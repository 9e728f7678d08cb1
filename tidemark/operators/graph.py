"""Connected components by repeated contraction.

Each level a rule gives every vertex of the remaining edges a cluster; the edges are
rewritten to clusters and those inside one vanish. The levels' assignments are
composed at the end. An adjacency list is never one value: a vertex with a third of all
edges is many rows, and rows of a vertex with more than ``HUB`` are spread over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch

Rule = Callable[[Scratch, DataFrame, int, "DataFrame | None"], DataFrame]
# Rows of one key, and of one bucket of written edges, that one task may well hold.
HUB, BUCKET_ROWS = 200_000, 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges with ``src < dst``; loops and edges without an end go."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return (
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(low.alias("src"), high.alias("dst"))
        .distinct()
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def salted_join(rows: DataFrame, named: DataFrame, key: str, hubs: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``named``, which has each ``key`` once; rows of a key in ``hubs`` (``node, parts``) are spread over its parts.

    ``hubs`` is broadcast: it has at most one row for each ``HUB`` rows that were counted.
    """
    if hubs is None:
        return rows.join(named, key, how)
    parts = F.broadcast(hubs.select(F.col("node").alias(key), F.col("parts").alias("_parts")))
    spread = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    left = rows.join(parts, key, "left").withColumn("_part", spread).drop("_parts")
    right = named.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def hubs_of(scratch: Scratch, counted: DataFrame) -> DataFrame | None:
    """``node, parts`` of the nodes with more than ``HUB`` rows, from ``node, n``; None if there are none."""
    hubs = scratch.save(counted.where(F.col("n") > HUB).select("node", F.ceil(F.col("n") / HUB).cast("int").alias("parts")), "hubs")
    return None if hubs.isEmpty() else hubs


class Adjacency:
    """The edges of a graph in both directions, written in buckets by the hash of their source.

    Neighbours of a hub lie in as many buckets as its parts. A front is sent to the buckets, or to all
    readers where it is small; the edges themselves are never shuffled again.
    """

    def __init__(self, scratch: Scratch, edges: DataFrame, hubs: DataFrame | None = None) -> None:
        both, self.hubs = both_ways(edges), hubs
        part = F.lit(0)
        if hubs is not None:
            both = both.join(F.broadcast(hubs.withColumnRenamed("node", "src")), "src", "left")
            part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
        buckets = max(1, 2 * edges.count() // BUCKET_ROWS)
        self.table = scratch.bucketed(both.select("src", "dst", part.alias("part")), ("src", "part"), buckets, "adjacency")

    def reached(self, front: DataFrame) -> DataFrame:
        """``node`` and the other columns of ``front`` (``node`` and others) at every neighbour."""
        others = [c for c in front.columns if c != "node"]
        if self.hubs is None:
            sent = front.withColumn("part", F.lit(0))
        else:
            sent = front.join(F.broadcast(self.hubs), "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = sent.withColumnRenamed("node", "src").join(self.table, ["src", "part"])
        return met.select(F.col("dst").alias("node"), *others)


def hook_to_smallest(scratch: Scratch, edges: DataFrame, level: int, hubs: DataFrame | None = None) -> DataFrame:
    """The rule for general use: a vertex joins the smallest hash among itself and its neighbours."""
    draw = lambda c: F.xxhash64(c, F.lit(level))
    near = both_ways(edges).select("src", F.explode(F.array("src", "dst")).alias("near"))
    best = near.groupBy("src").agg(F.min_by("near", draw("near")).alias("label"))
    return best.select(F.col("src").alias("node"), "label")


def contract(edges: DataFrame, assigned: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Edges between the clusters of ``assigned`` (node, label)."""
    src = assigned.select(F.col("node").alias("src"), F.col("label").alias("src_label"))
    dst = assigned.select(F.col("node").alias("dst"), F.col("label").alias("dst_label"))
    moved = salted_join(salted_join(edges, src, "src", hubs), dst, "dst", hubs)
    return undirected(moved.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")))


def components(scratch: Scratch, edges: DataFrame, rule: Rule = hook_to_smallest) -> DataFrame:
    """``node, component`` of every vertex that has an edge to another.

    ``edges`` has ``src, dst`` of one type. The component is one of its vertices, the
    same for all, not necessarily the smallest.
    """
    level, levels = 0, []
    left = scratch.save(undirected(edges), "edges")
    while not left.isEmpty():
        before = scratch.held()
        ends = left.select(F.explode(F.array("src", "dst")).alias("node"))
        hubs = hubs_of(scratch, ends.groupBy("node").agg(F.count("*").alias("n")))
        assigned = scratch.save(rule(scratch, left, level, hubs), f"level{level}")
        levels.append(assigned)
        smaller = scratch.save(contract(left, assigned, hubs), "edges")
        scratch.keep(*before, assigned, smaller)
        scratch.drop(left)
        left, level = smaller, level + 1
    if not levels:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    whole = levels[-1]
    for finer in reversed(levels[:-1]):
        up = whole.select(F.col("node").alias("label"), F.col("label").alias("above"))
        whole = finer.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
    return whole.select("node", F.col("label").alias("component"))


def with_smallest(scratch: Scratch, members: DataFrame) -> DataFrame:
    """``node, group_id``: the component named by its smallest vertex."""
    least = scratch.save(members.groupBy("component").agg(F.min("node").alias("group_id"), F.count("*").alias("n")), "least")
    hubs = hubs_of(scratch, least.select(F.col("component").alias("node"), "n"))
    return salted_join(members, least.select("component", "group_id"), "component", hubs).select("node", "group_id")
