"""Manifests, domain maps, chunks of predictions, and rendered reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.naming import first_by

MANIFEST = "split string, domain string, dataset string, stem string, num_boxes int, classes string"


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The manifest with ``classes`` as an array; only one split if named."""
    rows = spark.read.schema(MANIFEST).option("header", True).csv(path)
    rows = rows if split is None else rows.where(F.col("split") == split)
    return rows.withColumn("classes", F.filter(F.transform(F.split(F.coalesce("classes", F.lit("")), r"\|"), lambda c: c.try_cast("int")), lambda c: c.isNotNull()))


def write_manifest(rows: DataFrame, path: str) -> None:
    """The manifest as CSV in the order of split and stem."""
    rows.orderBy("split", "stem").write.mode("overwrite").option("header", True).csv(path)


def domain_json(items: DataFrame, most: int = 100_000) -> DataFrame:
    """``split, part, domains``: JSON objects from stem to domain for each split, as files of that layout hold them.

    A split of more than ``most`` stems is several objects, by the hash of the stem, as one value cannot hold any number.
    """
    pairs = items.groupBy("split", "stem").agg(F.min("domain").alias("domain"))
    parts = pairs.groupBy("split").agg(F.ceil(F.count("*") / most).alias("parts"))
    placed = pairs.join(F.broadcast(parts), "split").withColumn("part", F.pmod(F.xxhash64("stem"), F.col("parts")))
    return placed.groupBy("split", "part").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stem", "domain"))))).alias("domains"))


def flat_domains(texts: DataFrame) -> DataFrame:
    """``split, stem, domain`` of rows with ``split, domains`` (JSON); a text that does not parse gives nothing."""
    return texts.select("split", F.explode(F.from_json("domains", "map<string, string>")).alias("stem", "domain"))


def write_chunk(samples: DataFrame, path: str, chunk: int) -> None:
    """One chunk of predictions below ``path``, replacing the chunk of that number."""
    samples.write.mode("overwrite").parquet(f"{path}/chunk={chunk}")


def read_chunks(spark: SparkSession, path: str, key: str = "stem") -> DataFrame:
    """All chunks; of a stem in several, the rows of the lowest chunk."""
    rows = spark.read.parquet(path)
    first = rows.groupBy(key).agg(F.min("chunk").alias("chunk"))
    return rows.join(first, [key, "chunk"], "left_semi")


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in the order of the columns."""
    return first_by(rows, [key], F.struct(*order))


def scrape_tables(texts: DataFrame, column: str = "text") -> DataFrame:
    """The other columns and ``row_no, cells`` of the table rows (bars at both ends) in markdown texts; rules are left out."""
    others = [c for c in texts.columns if c != column]
    lines = texts.select(*others, F.posexplode(F.split(column, r"\r\n|\n|\r")).alias("row_no", "line"))
    rows = lines.where(F.col("line").rlike(r"(?s)^[ \t]*\|.*\|[ \t]*\z") & ~F.col("line").rlike(r"^[ \t|:-]+\z"))
    inner = F.regexp_replace("line", r"^[ \t]*\||\|[ \t]*\z", "")
    return rows.select(*others, "row_no", F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c)).alias("cells"))


def markdown(rows: DataFrame, most: int = 500) -> str:
    """A small result as a markdown table; an error beyond ``most`` rows."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows are not a report")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else re.sub(r"\|", r"\\|", str(v))
    head = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join([*head, *(f"| {' | '.join(map(show, r))} |" for r in held)]) + "\n"
