"""Consolidating pairwise match decisions into groups.

Components by low-diameter decomposition. At each level every vertex draws an
exponential shift; the larger the shift, the earlier it starts a cluster of its own,
unless a cluster has reached it before. Clusters grow one hop a round, are contracted
to super-vertices, and the edges left between clusters are treated the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.scalars import micros
from tidemark.operators.graph import Adjacency, components, with_smallest
from tidemark.session import Scratch

RATE = 0.2


def shifted_clusters(rate: float = RATE, seed: int = 42):
    """The contraction rule.

    A vertex joins the cluster whose front arrives first, counted as hops minus the exponential shift of
    its centre. Only vertices whose arrival has improved pass it on, until none has. With n vertices no shift is likely to exceed
    2 ln n / ``rate``, and no cluster grows by more hops than that; an edge is left between clusters with a chance of at most
    1 - exp(-``rate``), on every level alike.
    """

    def rule(scratch: Scratch, edges: DataFrame, level: int, hubs: DataFrame | None = None) -> DataFrame:
        adjacency = Adjacency(scratch, edges, hubs)
        start = lambda c: F.log1p(-(F.shiftrightunsigned(F.xxhash64(c, F.lit(seed), F.lit(level)), 11) / F.lit(float(1 << 53)))) / rate
        # The first hop needs no front: every vertex has its own start and those of its neighbours.
        every = adjacency.table.select(F.col("src").alias("node"), F.explode(F.array(F.struct(start("src").alias("at"), F.col("src").alias("label")), F.struct((start("dst") + 1).alias("at"), F.col("dst").alias("label")))).alias("a"))
        best = every.groupBy("node").agg(F.min("a.at").alias("at"), F.min_by("a.label", "a.at").alias("label"))
        now = scratch.save(best.select("node", "at", "label", (F.col("label") != F.col("node")).alias("moved")), "arrivals")
        while True:
            front = now.where("moved").select("node", (F.col("at") + 1).alias("new_at"), F.col("label").alias("new_label"))
            passed = adjacency.reached(front).groupBy("node").agg(F.min("new_at").alias("new_at"), F.min_by("new_label", "new_at").alias("new_label"))
            better = F.coalesce(F.col("new_at") < F.col("at"), F.lit(False))
            met = now.drop("moved").join(passed, "node", "left")
            after = met.select("node", F.when(better, F.col("new_at")).otherwise(F.col("at")).alias("at"), F.when(better, F.col("new_label")).otherwise(F.col("label")).alias("label"), better.alias("moved"))
            seen = Observation()
            after = scratch.save(after.observe(seen, F.count_if("moved").alias("moved")), "arrivals")
            scratch.drop(now)
            now = after
            if not seen.get["moved"]:
                return now.select("node", "label")

    return rule


def decided_edges(pairs: DataFrame) -> DataFrame:
    """``src, dst`` of the item pairs whose latest row says match.

    A pair counts in either order; the row with the latest ``matched_at`` and then the
    largest ``pair_id`` decides, undecided verdicts included. A null ``matched_at``
    comes before every time. Rows with an end missing, or one item at both ends, count
    for nothing.
    """
    ends = pairs.where(F.col("item_a").isNotNull() & F.col("item_b").isNotNull() & (F.col("item_a") != F.col("item_b")))
    # One number in the order of time and id, nulls first; a flat value needs no sorted aggregate.
    turn = F.coalesce(micros(F.col("matched_at")), F.lit(-(10**18))).cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.coalesce(F.col("pair_id"), F.lit(-(1 << 63))).cast("decimal(20,0)")
    rows = ends.select(F.least("item_a", "item_b").alias("src"), F.greatest("item_a", "item_b").alias("dst"), turn.cast("decimal(38,0)").alias("turn"), (text.word(F.col("verdict")) == "match").alias("says"))
    return rows.groupBy("src", "dst").agg(F.max_by("says", "turn").alias("says")).where("says").select("src", "dst")


def consolidate(pairs: DataFrame) -> DataFrame:
    """``item_id, group_id`` of every item in a group of two or more; the id is the smallest member.

    No pairs, or none that match, give an empty result.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    members = scratch.save(components(scratch, decided_edges(pairs), shifted_clusters()), "members")
    return scratch.finish(with_smallest(scratch, members).select(F.col("node").alias("item_id"), "group_id"))


def all_items(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """``item_id, group_id, members`` of every item, matched or not; an unmatched item is its own group."""
    spark = items.sparkSession
    scratch = Scratch(spark, "grouped")
    grouped = consolidate(pairs)
    sizes = scratch.save(grouped.groupBy("group_id").agg(F.count("*").alias("members")), "sizes")
    every = items.select("item_id").where(F.col("item_id").isNotNull()).unionAll(grouped.select("item_id")).distinct()
    named = every.join(grouped, "item_id", "left").select("item_id", F.coalesce("group_id", "item_id").alias("group_id"))
    return scratch.finish(named.join(sizes, "group_id", "left").select("item_id", "group_id", F.coalesce("members", F.lit(1)).alias("members")))
