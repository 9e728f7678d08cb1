"""The queries of this subpackage: each takes a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import groups, history, mixing, overlap, proportions, quality, related_splits, survivors, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _over(*tables: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query that reads these tables and hands them to a function."""

    def wrap(make: Callable[..., DataFrame]) -> Query:
        return lambda spark, folder: make(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in tables))

    return wrap


SAMPLE = ("items", "class_names", "dataset_domains", "sample_targets")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over("items")(related_splits.divided_groups),
        "p1_splits": _over("items")(related_splits.assign_splits),
        "p2_found": _over(*SAMPLE)(lambda *t: proportions.shortfalls(*t).where("short").select("request_id", "category")),
        "p2_sample": _over(*SAMPLE)(proportions.draw),
        "p2_report": _over(*SAMPLE)(proportions.shortfalls),
        "p3_found": _over("items", "new_items")(lambda *t: history.screened(*t).where(~F.col("accepted")).select("new_id")),
        "p3_accepted": _over("items", "new_items")(lambda *t: history.screened(*t).where("accepted").select("new_id")),
        "p4_found": _over("items", "class_names", "dataset_domains")(survivors.trusted),
        "p4_records": _over("items", "class_names", "dataset_domains")(survivors.fuse),
        "p6_found": _over("match_pairs")(groups.consolidate),
        "p6_all_items": _over("items", "match_pairs")(groups.all_items),
        "p7_found": _over("items")(overlap.overlapping_pairs),
        "p7_report": _over("items")(overlap.overlap_report),
        "p7_covered": _over("items")(overlap.covered_report),
        "p8_ids": _over("documents")(tokens.encode_corpus),
        "p8_offsets": _over("documents")(tokens.encode_with_offsets),
        "p8_round_trip": _over("documents")(tokens.round_trip),
        "p9_found": _over("documents", "mix_targets")(mixing.capped_sources),
        "p9_mix": _over("documents", "mix_targets")(mixing.mix),
        "p9_shares": _over("documents", "mix_targets")(mixing.shares),
        "p10_found": _over("documents", "common_words")(lambda *t: quality.document_quality(*t).where(F.col("kind").isNotNull()).select("doc_id", "kind")),
        "p10_statistics": _over("documents", "common_words")(quality.statistics_table),
    }
