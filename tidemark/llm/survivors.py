"""The best representative of each group of duplicate items.

Items with one real hash are claims about one picture by their datasets. A latent
two-sided quality model gives each dataset, field by field, a sensitivity (how often it
states a value that is true) and a specificity (how often it leaves out one that is
not), by expectation-maximisation. ``fuse`` lets it decide: of a field with one value the most probable one
survives, and of the multi-valued field ``classes`` every value that is probably true. ``trusted``
takes the value of the member that a fixed order of trust puts first instead, and no model.

Facts that the same datasets state and the same leave out have one posterior, so the
iterations run over counted patterns, not over facts, until the qualities stand still; what returns to the
driver in each is one row for a dataset and field.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bits, text
from tidemark.functions.scalars import micros
from tidemark.llm.images import class_ids
from tidemark.session import Scratch

FIELDS = ("num_boxes", "classes", "domain", "licence", "captured_at")
# Rounds end when no quality moves by more than this, or after so many; each round only raises the likelihood.
STILL, MOST_ROUNDS = 5e-3, 200
MOST_SOURCES = 100_000
# Pseudo-counts that keep the estimates off 0 and 1: expected sensitivity 0.8, specificity 0.9, half of the facts true.
PRIOR = {"tp": 8.0, "fn": 2.0, "tn": 9.0, "fp": 1.0, "true": 1.0, "false": 1.0}


def _members(scratch: Scratch, items: DataFrame, classes: DataFrame, domains: DataFrame) -> DataFrame:
    """Items whose real hash another item has: their dataset, its trust, and the filled values of each field, null where not filled."""
    known = F.array(*(F.lit(c) for c in class_ids(classes))).cast("array<int>")
    listed = lambda c: F.when(F.size(F.array_compact(c)) > 0, F.array_compact(c))
    rows = scratch.save(items.where(F.col("item_id").isNotNull() & bits.real(F.col("hash")).isNotNull()).select(
        "item_id", "hash", text.word(F.col("dataset")).alias("source"), "loaded_at",
        F.when(F.col("num_boxes") >= 1, F.array(F.col("num_boxes").cast("string"))).alias("num_boxes"),
        listed(F.array_intersect(F.array_distinct("classes"), known).cast("array<string>")).alias("classes"),
        *(listed(F.array(text.present(F.col(c), text.word(F.col(c))))).alias(c) for c in ("domain", "licence")),
        F.when(F.col("captured_at").isNotNull(), F.array(F.col("captured_at").cast("string"))).alias("captured_at"),
    ), "rows")
    # Hashes of two different items; repeated rows of one item are one.
    shared = rows.groupBy("hash").agg(F.min("item_id").alias("low"), F.max("item_id").alias("high")).where(F.col("low") < F.col("high"))
    trust = domains.groupBy(text.word(F.col("dataset")).alias("source")).agg(F.min("trust_rank").alias("trust_rank"))
    members = rows.join(shared.select("hash"), "hash", "left_semi").distinct().join(trust, "source", "left")
    return scratch.save(members.select("item_id", "hash", "source", "loaded_at", "trust_rank", *FIELDS), "members")


def _told(members: DataFrame) -> DataFrame:
    """``hash, source, item_id, rank, field, held``: the filled fields of every member, and its place in the order of trust, least first."""
    # Datasets without a rank come last, then a null loaded_at, then the larger ids.
    late = F.coalesce(-micros(F.col("loaded_at")), F.lit(9223372036854775807))
    rank = F.struct(F.coalesce(F.col("trust_rank"), F.lit(2147483647)).alias("trust"), late.alias("late"), F.col("item_id").alias("item_id"))
    each = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("held")) for f in FIELDS)), lambda x: x["held"].isNotNull())
    return members.select("hash", F.coalesce("source", F.lit("")).alias("source"), "item_id", rank.alias("rank"), F.explode(each).alias("x")).select("hash", "source", "item_id", "rank", "x.field", "x.held")


def _patterns(scratch: Scratch, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts ``hash, field, value, pattern`` of what members tell, and the patterns with their counts."""
    # Members without a dataset are one more source.
    told = members.select("hash", "source", "field", F.explode("held").alias("value"))
    stated = told.groupBy("hash", "field", "value").agg(F.collect_set("source").alias("stated"))
    covering = told.groupBy("hash", "field").agg(F.collect_set("source").alias("covering"))
    pattern = F.struct(F.sort_array("stated").alias("stated"), F.sort_array(F.array_except("covering", "stated")).alias("silent"))
    facts = scratch.save(stated.join(covering, ["hash", "field"]).select("hash", "field", "value", pattern.alias("pattern")), "facts")
    return facts, scratch.save(facts.groupBy("field", "pattern").agg(F.count("*").alias("facts")), "patterns")


def quality_model(scratch: Scratch, patterns: DataFrame, still: float = STILL) -> tuple[DataFrame, DataFrame]:
    """``(posteriors, qualities)``: ``field, pattern, p_true`` and ``field, source, sensitivity, specificity, share_true``."""
    spark = patterns.sparkSession
    seen = patterns.select("field", "pattern", "facts", F.explode(F.concat(
        F.transform("pattern.stated", lambda s: F.struct(s.alias("source"), F.lit(True).alias("says"))),
        F.transform("pattern.silent", lambda s: F.struct(s.alias("source"), F.lit(False).alias("says"))),
    )).alias("o")).select("field", "pattern", "facts", "o.source", "o.says")
    shape = "field string, source string, sensitivity double, specificity double, share_true double"
    names = seen.select("field", "source").distinct()
    if (count := names.count()) > MOST_SOURCES:
        raise ValueError(f"{count} sources and fields are more than one table of parameters may hold")
    held = [(r.field, r.source, 0.8, 0.9, 0.5) for r in names.collect()]
    params = spark.createDataFrame(held, shape)

    def judge(params: DataFrame) -> DataFrame:
        says = F.when(F.col("says"), F.log(F.col("sensitivity") / (1 - F.col("specificity")))).otherwise(F.log((1 - F.col("sensitivity")) / F.col("specificity")))
        odds = seen.join(F.broadcast(params), ["field", "source"]).groupBy("field", "pattern", "facts").agg((F.sum(says) + F.max(F.log(F.col("share_true") / (1 - F.col("share_true"))))).alias("odds"))
        return odds.select("field", "pattern", "facts", (1 / (1 + F.exp(-F.col("odds")))).alias("p_true"))

    for _ in range(MOST_ROUNDS):
        weighed = seen.join(judge(params).drop("facts"), ["field", "pattern"])
        true, false = F.col("facts") * F.col("p_true"), F.col("facts") * (1 - F.col("p_true"))
        sums = weighed.groupBy("field", "source").agg(*(
            F.sum(F.when(F.col("says") == said, amount).otherwise(0.0)).alias(name)
            for name, said, amount in (("tp", True, true), ("fn", False, true), ("fp", True, false), ("tn", False, false))
        ))
        rows, share = sums.collect(), {}
        for r in rows:
            t, f = share.get(r.field, (PRIOR["true"], PRIOR["false"]))
            share[r.field] = (t + r.tp + r.fn, f + r.fp + r.tn)
        shrunk = lambda a, b, pa, pb: (a + pa) / (a + b + pa + pb)
        before = {(field, source): values for field, source, *values in held}
        held = [(r.field, r.source, shrunk(r.tp, r.fn, PRIOR["tp"], PRIOR["fn"]), shrunk(r.tn, r.fp, PRIOR["tn"], PRIOR["fp"]), share[r.field][0] / math.fsum(share[r.field])) for r in rows]
        params = spark.createDataFrame(held, shape)
        if all(abs(a - b) <= still for field, source, *values in held for a, b in zip(values, before[field, source], strict=True)):
            break
    return scratch.save(judge(params).drop("facts"), "posteriors"), params


def trusted(items: DataFrame, classes: DataFrame, domains: DataFrame) -> DataFrame:
    """``hash, field, item_id``: the member whose value survives in the order of trust, for each duplicated hash and field filled by one.

    That is the lowest trust rank (datasets without one come last), then the latest ``loaded_at`` (null last), then the smallest
    id. Null and 0 hashes, and hashes of a single item, have no rows.
    """
    scratch = Scratch(items.sparkSession, "trusted")
    first = _told(_members(scratch, items, classes, domains)).groupBy("hash", "field").agg(F.min("rank").alias("rank"))
    return scratch.finish(first.select("hash", "field", F.col("rank.item_id").alias("item_id")))


def fuse(items: DataFrame, classes: DataFrame, domains: DataFrame) -> DataFrame:
    """``hash, field, item_id, p_true, kept, as_trusted``: one row for each duplicated hash and field filled by a member.

    ``item_id`` is the member whose value the model holds most probable (for classes, whose least probable value is), ties in the order
    of ``trusted``, and ``p_true`` that probability; members without a dataset are judged as one source. ``kept`` are the values of the field
    to keep: for classes all with a probability of one half or more over all members, or the survivor's where none reaches it; else the
    survivor's value. ``as_trusted`` tells whether the order of trust would keep the same value of that member's field.
    Null and 0 hashes, and hashes of a single item, have no rows.
    """
    scratch = Scratch(items.sparkSession, "survivors")
    told = scratch.save(_told(_members(scratch, items, classes, domains)), "told")
    facts, patterns = _patterns(scratch, told)
    posteriors, _ = quality_model(scratch, patterns)
    judged = scratch.save(facts.join(posteriors, ["field", "pattern"]).select("hash", "field", "value", "p_true"), "judged")
    # Members that hold the same values of a field share its probability, so each held list is judged once.
    lists = told.groupBy("hash", "field", "held").agg(F.min("rank").alias("rank"))
    sure = lists.select("hash", "field", "held", "rank", F.explode("held").alias("value")).join(judged, ["hash", "field", "value"])
    sure = sure.groupBy("hash", "field", "held", "rank").agg(F.min("p_true").alias("p_true"))
    # Probabilities are compared to nine digits, so that the order of a sum decides nothing.
    best = F.min(F.struct(-F.round("p_true", 9), "rank", "held", "p_true"))
    chosen = sure.groupBy("hash", "field").agg(best.alias("b"), F.min(F.struct("rank", "held")).alias("t"))
    likely = judged.where((F.col("p_true") >= 0.5) & (F.col("field") == "classes")).groupBy("hash", "field").agg(F.sort_array(F.collect_set("value")).alias("likely"))
    fused = chosen.join(likely, ["hash", "field"], "left")
    return scratch.finish(fused.select(
        "hash", "field", F.col("b.rank.item_id").alias("item_id"), F.col("b.p_true").alias("p_true"),
        F.coalesce("likely", F.sort_array("b.held")).alias("kept"), (F.sort_array("b.held") == F.sort_array("t.held")).alias("as_trusted"),
    ))
