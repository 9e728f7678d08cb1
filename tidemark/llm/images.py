"""Normal forms of image records that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bits, text


def records(table: DataFrame, id_column: str, *extra: Column) -> DataFrame:
    """One row for each id with ``id, stem_key, real_hash`` and the extra columns.

    Repeated rows are identical and count once, so they are told by all their columns, which needs no sort.
    Rows without an id are dropped: there is nothing to report about them.
    """
    return (
        table.where(F.col(id_column).isNotNull())
        .select(F.col(id_column).alias("id"), text.stem(F.col("stem")).alias("stem_key"), bits.real(F.col("hash")).alias("real_hash"), *extra)
        .distinct()
    )


def valid_classes(classes: DataFrame) -> DataFrame:
    """The distinct class ids of the taxonomy."""
    return classes.select("class_id").where(F.col("class_id").isNotNull()).distinct()


def class_ids(classes: DataFrame, most: int = 10_000) -> list[int]:
    """The taxonomy as a list; an error if it has more than ``most`` classes."""
    rows = valid_classes(classes).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a taxonomy of more than {most} classes cannot be a literal")
    return sorted(r.class_id for r in rows)
