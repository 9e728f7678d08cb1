"""The same or nearly the same images across splits.

Stems are normalised and cut where a rolling hash of their last bytes has its low
bits clear, so equal stretches give equal chunks wherever they stand. Chunk digests are joined
across splits, and the lengths of the chunks that two stems share, over the length of the longer, are their overlap.
The pairs with an overlap of ``least`` or more are found through the rarest chunks of both: where chunks are taken
from the rarest on, a pair with that overlap shares one before the rest becomes too short, so
no common chunk is joined. Two stems are the same if their overlap is 1 and they then prove equal as a whole
(chunks may stand in another order). The fraction of a stem that any training chunks cover is reported as well.

Content-defined cuts cannot promise a shared chunk of two 64-bit hashes that differ
in three bits, as each change moves the cuts around it. Hashes are therefore cut at
fixed places and joined on the digests of two of five chunks, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.llm.images import records
from tidemark.llm.shapes import digests
from tidemark.operators.hamming import cheapest_agree, hamming_join
from tidemark.session import Scratch

WINDOW = 4
MASK = 7

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, starts: np.ndarray, window: int = WINDOW, mask: int = MASK) -> np.ndarray:
    """Where chunks begin in records laid end to end; ``starts`` are the places where records begin, none of them empty."""
    if not len(data):
        return np.zeros(0, np.int64)
    drawn, rolling = _GEAR[data], np.zeros(len(data), np.uint32)
    lengths = np.diff(np.concatenate([starts, [len(data)]]))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    for back in range(min(window, len(data))):
        there = place[back:] >= back
        rolling[back:] += np.where(there, drawn[: len(data) - back] << np.uint32(3 * back), np.uint32(0))
    ends = np.flatnonzero((rolling >> np.uint32(7)) & np.uint32(mask) == 0) + 1
    return np.union1d(ends[ends < len(data)], starts)


def cut(data: bytes, window: int = WINDOW, mask: int = MASK) -> list[bytes]:
    """The content-defined chunks of a record, in order; joined they are the record."""
    at = cuts(np.frombuffer(data, np.uint8), np.zeros(min(1, len(data)), np.int64), window, mask).tolist()
    return [data[a:b] for a, b in zip(at, [*at, len(data)][1:], strict=True)]


def chunks(table: DataFrame, column: str) -> DataFrame:
    """The columns of ``table`` and ``digest, length, size`` (of chunk and text) of each chunk of the distinct texts in ``column``; the n-th of equal chunks has a digest of its own."""
    names = table.columns

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(column).cast(pa.large_binary()).to_pylist()
            sizes = np.array([len(t) for t in held], np.int64)
            data, filled = np.frombuffer(b"".join(held), np.uint8), np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes[filled])])[:-1].astype(np.int64) if len(filled) else np.zeros(0, np.int64)
            at = cuts(data, starts)
            ends = np.concatenate([at[1:], [len(data)]]) if len(at) else at
            of = filled[np.searchsorted(starts, at, "right") - 1] if len(at) else np.zeros(0, np.int64)
            found = digests(data, at, ends)
            # The number of a chunk among the equal ones of its record.
            order = np.lexsort((found, of))
            fresh = np.concatenate([[True], (found[order][1:] != found[order][:-1]) | (of[order][1:] != of[order][:-1])])[: len(order)]
            run = np.flatnonzero(fresh)
            nth = np.arange(len(order)) - np.repeat(run, np.diff(np.concatenate([run, [len(order)]])))
            found[order] += nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            rows = batch.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found.view(np.int64)), pa.array((ends - at).astype(np.int32)), pa.array(sizes[of].astype(np.int32))], [*names, "digest", "length", "size"])

    shape = ", ".join(f"`{c}` {t}" for c, t in table.dtypes)
    return table.mapInArrow(cut_all, f"{shape}, digest bigint, length int, size int")


def covered(evaluation: DataFrame, training: DataFrame, column: str) -> DataFrame:
    """``column, fraction``: how much of each evaluation text consists of chunks of training texts, from the ``chunks`` of both."""
    known = training.select("digest").distinct().withColumn("known", F.lit(1))
    found = evaluation.join(known, "digest", "left")
    shared = F.sum(F.when(F.col("known") == 1, F.col("length")).otherwise(0))
    return found.groupBy(column).agg((shared / F.sum("length")).alias("fraction"))


def overlaps(evaluation: DataFrame, training: DataFrame, column: str, least: float = 1.0) -> DataFrame:
    """``held, known, overlap``: evaluation and training texts that share chunks of at least ``least`` of the longer one's length, from the ``chunks`` of both."""
    held = evaluation.groupBy("digest").agg(F.count("*").alias("n")).unionAll(training.groupBy("digest").agg(F.count("*").alias("n")))
    seen = held.groupBy("digest").agg(F.sum("n").alias("seen"), F.count("*").alias("sides")).where(F.col("sides") == 2)

    def rare(side: DataFrame, name: str) -> DataFrame:
        # Chunks of one side only are the rarest: they take from the length that can be shared, and join nothing.
        met, own = side.join(seen, "digest"), Window.partitionBy(column)
        before = F.sum("length").over(own.orderBy("seen", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
        left = F.sum("length").over(own) - before
        return met.withColumn("left", left).where(F.col("left") >= F.lit(least) * F.col("size")).select(F.col(column).alias(name), "digest", F.col("size").alias(f"{name}_size"))

    pairs = rare(evaluation, "held").join(rare(training, "known"), "digest").where(F.least("held_size", "known_size") >= F.lit(least) * F.greatest("held_size", "known_size"))
    pairs = pairs.select("held", "known", F.greatest("held_size", "known_size").alias("longer")).distinct()
    a, b = evaluation.select(F.col(column).alias("held"), "digest", "length"), training.select(F.col(column).alias("known"), "digest")
    shared = pairs.join(a, "held").join(b, ["known", "digest"]).groupBy("held", "known", "longer").agg(F.sum("length").alias("shared"))
    return shared.select("held", "known", (F.col("shared") / F.col("longer")).alias("overlap")).where(F.col("overlap") >= least)


def _sides(scratch: Scratch, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = scratch.save(records(items, "item_id", text.word(F.col("split")).alias("split"), text.word(F.col("dataset")).alias("dataset")).where(F.col("split").isin("train", "val", "test")), "records")
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")


def _distinct(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def _cut_sides(scratch: Scratch, train: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of the distinct stems of the evaluation and of the training side."""
    return scratch.save(chunks(_distinct(held, "stem_key"), "stem_key"), "held-chunks"), scratch.save(chunks(_distinct(train, "stem_key"), "stem_key"), "train-chunks")


def _links(scratch: Scratch, train: DataFrame, held: DataFrame, threshold: int, sides: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The stems that are the same on both sides, and the near pairs of distinct hashes across the sides."""
    same = overlaps(*sides, "stem_key").where(F.col("held") == F.col("known")).select(F.col("held").alias("stem_key"))
    a = _distinct(held, "real_hash").select(F.col("real_hash").alias("hash"))
    b = _distinct(train, "real_hash").select(F.col("real_hash").alias("hash"))
    return scratch.save(same, "stems"), scratch.save(hamming_join(a, b, threshold=threshold, agree=cheapest_agree(train.count() + held.count(), threshold)), "hashes")


def overlapping_pairs(items: DataFrame, threshold: int = 3) -> DataFrame:
    """``item_id_a, item_id_b`` of every pair of items that show the same image, one in train and one in val or test.

    The smaller id comes first. Null stems and null or 0 hashes show no image. Groups of
    copies are compared once; their members are paired only here, at the end.
    """
    scratch = Scratch(items.sparkSession, "overlap")
    train, held = _sides(scratch, items)
    stems, hashes = _links(scratch, train, held, threshold, _cut_sides(scratch, train, held))
    left, right = train.select(F.col("id").alias("t"), "stem_key"), held.select(F.col("id").alias("e"), "stem_key")
    by_stem = right.join(stems, "stem_key").join(left, "stem_key").select("t", "e")
    t_hash, e_hash = train.select(F.col("id").alias("t"), F.col("real_hash").alias("hash_b")), held.select(F.col("id").alias("e"), F.col("real_hash").alias("hash_a"))
    by_hash = hashes.join(e_hash, "hash_a").join(t_hash, "hash_b").select("t", "e")
    pairs = by_stem.unionAll(by_hash).select(F.least("t", "e").alias("item_id_a"), F.greatest("t", "e").alias("item_id_b")).distinct()
    return scratch.finish(pairs)


def overlap_report(items: DataFrame, threshold: int = 3) -> DataFrame:
    """``split, dataset, items, overlapping, same_stem, same_hash, near_hash`` of val and test.

    Counts of items with at least one partner in train; no pair is formed. ``dataset`` is null where it is null.
    """
    scratch = Scratch(items.sparkSession, "overlaps")
    train, held = _sides(scratch, items)
    stems, hashes = _links(scratch, train, held, threshold, _cut_sides(scratch, train, held))
    least = hashes.groupBy(F.col("hash_a").alias("real_hash")).agg(F.min("dist").alias("dist"))
    marked = held.join(stems.withColumn("stem", F.lit(True)), "stem_key", "left").join(least, "real_hash", "left")
    same = F.coalesce("stem", F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    report = marked.groupBy("split", "dataset").agg(
        F.count("*").alias("items"), count(same | F.col("dist").isNotNull()).alias("overlapping"), count(same).alias("same_stem"),
        count(F.col("dist") == 0).alias("same_hash"), count(F.col("dist") > 0).alias("near_hash"),
    )
    return scratch.finish(report)


def covered_report(items: DataFrame) -> DataFrame:
    """``split, dataset, items, mean_covered`` of val and test: the mean fraction of the stems that chunks of training stems cover, null without a stem."""
    scratch = Scratch(items.sparkSession, "covered")
    train, held = _sides(scratch, items)
    fractions = covered(*_cut_sides(scratch, train, held), "stem_key")
    report = held.join(fractions, "stem_key", "left").groupBy("split", "dataset").agg(F.count("*").alias("items"), F.round(F.avg("fraction"), 6).alias("mean_covered"))
    return scratch.finish(report)
