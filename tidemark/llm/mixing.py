"""Mixing sources to target weights.

Tokens are summed by source; the repetition rate of a source in a mix is its weight times
the size of the mix over its tokens, at most its cap. Each document comes floor(rate) times
and once more with the fraction as probability, drawn by a seeded hash of mix and document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.llm.tokens import TOKENIZER, count_tokens
from tidemark.session import Scratch


def counted(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` of every document, the source as a word."""
    named = documents.select("doc_id", text.word(F.col("source")).alias("source"), "text")
    return count_tokens(named, ["doc_id", "source"], path)


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each row of ``targets`` with its tokens, repetition rate and whether the cap keeps it short.

    ``sizes``: ``source, tokens`` summed. A source without documents or tokens has the rate 0.
    ``capped`` compares weight times size with cap times tokens to six decimals.
    """
    asked = targets.select("mix_id", text.word(F.col("source")).alias("source"), "weight", "max_repeats", "total_tokens")
    wanted = F.col("weight") * F.col("total_tokens")
    most = F.col("max_repeats") * F.col("tokens")
    return (
        asked.join(sizes, "source", "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("rate", F.coalesce(F.least(F.try_divide(wanted, F.col("tokens")), F.col("max_repeats").cast("double")), F.lit(0.0)))
        .withColumn("capped", F.coalesce(F.round(wanted, 6) > most, F.lit(False)))
    )


def _sized(scratch: Scratch, documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    docs = scratch.save(counted(documents, path), "counted")
    sizes = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return docs, scratch.save(sizes, "sizes")


def capped_sources(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``mix_id, source`` of the targets that the cap on repeats keeps out of reach."""
    scratch = Scratch(documents.sparkSession, "capped")
    _, sizes = _sized(scratch, documents, path)
    return scratch.finish(rates(sizes, targets).where("capped").select("mix_id", "source"))


def _copies(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    picked = docs.join(plan.where(F.col("rate") > 0).select("mix_id", "source", "rate"), "source")
    return picked.select("mix_id", "source", "doc_id", "tokens", (whole + (draw < F.col("rate") - whole).cast("bigint")).alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, path: str = TOKENIZER) -> DataFrame:
    """``mix_id, source, doc_id, copy, tokens``: a row for each use of a document, copies counted from 1.

    Documents without a source, or of a source no mix names, are in none. A document without
    tokens is used as others of its source and adds nothing to the size.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    docs, sizes = _sized(scratch, documents, path)
    used = _copies(docs, rates(sizes, targets), seed).where(F.col("copies") > 0)
    rows = used.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "tokens")
    return scratch.finish(rows)


def shares(documents: DataFrame, targets: DataFrame, seed: int = 42, path: str = TOKENIZER) -> DataFrame:
    """The rows of ``targets`` with ``tokens, rate, capped`` and the actual ``documents, used_tokens, share``."""
    scratch = Scratch(documents.sparkSession, "shares")
    docs, sizes = _sized(scratch, documents, path)
    plan = rates(sizes, targets)
    used = _copies(docs, plan, seed).groupBy("mix_id", "source").agg(F.sum("copies").alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"))
    joined = plan.join(used, ["mix_id", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "used_tokens")})
    total = F.sum("used_tokens").over(Window.partitionBy("mix_id"))
    return scratch.finish(joined.withColumn("share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), total), F.lit(0.0))))
