"""Exact similarity joins of 64-bit hashes by Hamming distance.

Cut 64 bits into ``threshold + agree`` runs. Two hashes that differ in at most
``threshold`` bits leave at least ``agree`` runs untouched, so an equi join on every
choice of ``agree`` runs finds all of them. Five runs of which two agree give keys of
25 bits: a billion hashes make about thirty to a bucket, where the usual four
runs of 16 bits would make fifteen thousand; for a few million hashes those four are
cheaper, and ``cheapest_agree`` tells which to take. A pair is emitted only under the
first choice on which it agrees, which spares a shuffle to remove repeats.

Buckets that hold more than ``hot`` hashes are keyed once more by the bits that the
bucket leaves free, again by the pigeonhole rule, so that no bucket is compared as a
whole however many hashes it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bits

HOT = 2000
ROW = 40


def choices_of(threshold: int = 3, agree: int = 2) -> list[int]:
    """The masks of every choice of ``agree`` of the ``threshold + agree`` runs."""
    return bits.masks(list(range(64)), threshold + agree, agree)


def segments(hashes: DataFrame, threshold: int = 3, agree: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """``hash, choice, bucket`` and the columns ``keep``: the index rows of hashes, which can be stored and added to."""
    keys = F.array(*(F.col("hash").bitwiseAND(F.lit(bits.signed(m))) for m in choices_of(threshold, agree)))
    return hashes.select("hash", *keep, F.posexplode(keys).alias("choice", "bucket"))


def _rekeyed(hot: DataFrame, finer: list[list[int]]) -> DataFrame:
    per_choice = F.array(*(F.array(*(F.lit(bits.signed(m)) for m in inner)) for inner in finer))
    inner = F.transform(per_choice[F.col("choice")], lambda m: F.col("hash").bitwiseAND(m))
    return hot.select("hash", "choice", "bucket", F.posexplode(inner).alias("inner", "rest"))


def _matches(a: DataFrame, b: DataFrame, on: list[str], threshold: int, once, self_join: bool) -> DataFrame:
    a = a.withColumnRenamed("hash", "hash_a")
    b = b.withColumnRenamed("hash", "hash_b")
    xor = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    pairs = a.join(b, on).where(F.bit_count(xor) <= threshold).where(once(xor))
    if self_join:
        pairs = pairs.where(F.col("hash_a") < F.col("hash_b"))
    return pairs.select("hash_a", "hash_b", F.bit_count(xor).cast("int").alias("dist"))


def cheapest_agree(hashes: int, threshold: int = 3) -> int:
    """How many runs to agree on for so many hashes: more runs make more rows to shuffle and fewer candidates to compare.

    A shuffled row is taken to cost as much as ``ROW`` comparisons. The pairs are the same for every choice.
    """

    def cost(agree: int) -> float:
        return math.comb(threshold + agree, agree) * (ROW + hashes / 2 ** (64 * agree / (threshold + agree)) / 2)

    return min((1, 2, 3), key=cost)


def hamming_join(
    left: DataFrame, right: DataFrame | None = None, threshold: int = 3, agree: int = 2, hot: int = HOT
) -> DataFrame:
    """Pairs ``hash_a, hash_b, dist`` of hashes at most ``threshold`` bits apart.

    ``left`` and ``right`` have one column ``hash`` of distinct non-null values.
    Without ``right`` it is a self join and ``hash_a < hash_b`` as signed numbers;
    with it the pairs of distance 0 are among the result. Repeats must be removed and
    groups of exact copies collapsed beforehand, so that a much-copied
    picture is one row here.
    """
    a = segments(left, threshold, agree)
    return match_segments(a, None if right is None else segments(right, threshold, agree), threshold, agree, hot)


def hot_buckets(a: DataFrame, b: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """``choice, bucket`` of the buckets with more than ``hot`` rows of both sides together."""
    bucket = ["choice", "bucket"]
    sizes = a if b is None else a.select(*bucket).unionAll(b.select(*bucket))
    return sizes.groupBy(*bucket).count().where(F.col("count") > hot).select(*bucket)


def match_segments(
    a: DataFrame, b: DataFrame | None = None, threshold: int = 3, agree: int = 2, hot: int = HOT, over: DataFrame | bool | None = None
) -> DataFrame:
    """``hamming_join`` over rows that ``segments`` made, with the same ``threshold`` and ``agree``.

    ``over`` are the hot buckets if they are known, or False if there are none; otherwise they are counted.
    """
    self_join = b is None
    b = a if self_join else b
    choices = choices_of(threshold, agree)
    bucket = ["choice", "bucket"]
    plain = lambda xor: bits.first_mask(xor, choices) == F.col("choice")
    if over is None:
        over = hot_buckets(a, None if self_join else b, hot)
        over = False if over.isEmpty() else over
    if over is False:
        return _matches(a, b, bucket, threshold, plain, self_join)

    cool = _matches(a.join(over, bucket, "left_anti"), b, bucket, threshold, plain, self_join)
    free = [[p for p in range(64) if not mask >> p & 1] for mask in choices]
    finer = [bits.masks(positions, threshold + 3, 3) for positions in free]

    def plain_and_inner(xor):
        inner = F.lit(None).cast("int")
        for k, fine in enumerate(finer):
            inner = F.when(F.col("choice") == k, bits.first_mask(xor, fine)).otherwise(inner)
        return plain(xor) & (inner == F.col("inner"))

    a_hot = _rekeyed(a.join(over, bucket, "left_semi"), finer)
    b_hot = a_hot if self_join else _rekeyed(b.join(over, bucket, "left_semi"), finer)
    return cool.unionAll(_matches(a_hot, b_hot, [*bucket, "inner", "rest"], threshold, plain_and_inner, self_join))
