"""Loading delimited report lines: valid rows on one side, bad lines with a reason on the other.

A line is cut at its double quotes. In a well-formed line the pieces at even places
lie outside quotes and those at odd places inside; a doubled quote inside a field
shows as an empty even piece. Quoting is right if the number of pieces is odd, every
piece that follows a closing quote starts with a comma or ends the line, and every
piece before an opening quote ends with a comma or starts the line. All of it is
array expressions, linear in the length of the line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import let
from tidemark.functions.text import strip

# The columns of a report line.
REPORT_COLUMNS = (
    "run_id", "finished_at", "dataset", "images_converted", "images_skipped",
    "boxes_written", "boxes_degenerate", "skipped_files", "errors",
)


@dataclass(frozen=True)
class Rule:
    """What the value in one column must be: ``count``, ``count_or_empty``, ``time``, ``member``."""

    column: str
    check: str


REPORT_RULES = (
    Rule("run_id", "count"),
    Rule("finished_at", "time"),
    Rule("dataset", "member"),
    Rule("images_converted", "count_or_empty"),
    Rule("images_skipped", "count_or_empty"),
    Rule("boxes_written", "count_or_empty"),
    Rule("boxes_degenerate", "count_or_empty"),
)


def _well_quoted(pieces: Column) -> Column:
    def outside_ok(piece: Column, at: Column, last: Column) -> Column:
        doubled_or_edge = (piece == "") & (at > 0) & (at < last)
        after_close = (at == 0) | piece.startswith(",") | ((at == last) & (piece == ""))
        before_open = (at == last) | piece.endswith(",") | ((at == 0) & (piece == ""))
        return (at % 2 == 1) | doubled_or_edge | (after_close & before_open)

    def ok(held: Column, last: Column) -> Column:
        return (last % 2 == 0) & F.forall(F.transform(held, lambda piece, at: outside_ok(piece, at, last)), lambda x: x)

    # Both are named many times within the lambda, and would be computed anew for each piece.
    return let(pieces, lambda held: let(F.size(held) - 1, lambda last: ok(held, last)))


def _cells(pieces: Column) -> Column:
    """The fields as written. Chr 1 is escaped first, so that it can mark the separators."""
    safe = F.transform(pieces, lambda p: F.replace(p, F.lit("\x01"), F.lit("\x01e")))
    marked = F.transform(safe, lambda p, at: F.when(at % 2 == 0, F.replace(p, F.lit(","), F.lit("\x01s"))).otherwise(p))
    fields = F.split(F.array_join(marked, '"'), "\x01s", -1)
    return F.transform(fields, lambda f: F.replace(f, F.lit("\x01e"), F.lit("\x01")))


def _value(field: Column) -> Column:
    quoted = field.startswith('"')
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    return strip(F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field))


def _is_count(value: Column) -> Column:
    plain = F.regexp_replace(value, "^0+(?=[0-9])", "")
    return value.rlike(r"^[0-9]+\z") & (F.length(plain) <= 10) & (F.coalesce(plain.try_cast("bigint"), F.lit(-1)) <= 2147483647)


def _is_time(value: Column) -> Column:
    shaped = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z")
    return shaped & F.substring(value, 1, 10).try_cast("date").isNotNull() & (F.substring(value, 1, 4) != "0000")


def load_lines(
    lines: DataFrame,
    members: DataFrame,
    columns: tuple[str, ...] = REPORT_COLUMNS,
    rules: tuple[Rule, ...] = REPORT_RULES,
    line_id: str = "line_id",
    text: str = "raw_line",
) -> tuple[DataFrame, DataFrame]:
    """``(clean, rejects)`` of the records in ``lines``.

    ``rejects`` has ``line_id, reason, columns``: the first of ``quoting``, ``columns`` and
    ``value`` that applies and for ``value`` the names of the columns at fault.
    ``clean`` has ``line_id`` and the values by column name, as text without blanks at
    the ends, an empty value being null. ``members`` has one column of allowed words.

    Repeated ids count once. A null line is an empty line: it has one field, so its
    reason is ``columns``. A null id is kept as one more id. Other columns of
    ``lines`` are ignored, whatever their names.
    """
    spark = lines.sparkSession
    once = lines.select(F.col(line_id).alias("line_id"), F.coalesce(F.col(text), F.lit("")).alias("line")).distinct()
    pieces = F.split("line", '"', -1)
    parsed = once.select("line_id", _well_quoted(pieces).alias("quoted"), _cells(pieces).alias("cells"))
    broken = parsed.where(~F.col("quoted") | (F.size("cells") != len(columns))).select(
        "line_id",
        F.when(~F.col("quoted"), "quoting").otherwise("columns").alias("reason"),
        F.array().cast("array<string>").alias("columns"),
    )

    table = spark.createDataFrame([(columns.index(r.column), r.column, r.check) for r in rules], "at int, column string, check string")
    words = members.select(F.col(members.columns[0]).alias("value")).where(F.col("value").isNotNull()).distinct()
    whole = parsed.where(F.col("quoted") & (F.size("cells") == len(columns)))
    exploded = whole.select("line_id", F.posexplode("cells").alias("at", "field")).withColumn("value", _value(F.col("field")))
    # The rule table is a literal of this module, a row to a rule; only the members need a size check, which is left to the planner.
    ruled = exploded.join(F.broadcast(table), "at")
    # Only cells that must be members are looked up; the others get a key of their line that no member has, so that neither '' nor null is a hot key.
    beside = F.concat(F.lit("\x00"), F.col("line_id").cast("string"))
    sought = ruled.withColumn("sought", F.when(F.col("check") == "member", F.col("value")).otherwise(beside))
    ruled = sought.join(words.select(F.col("value").alias("sought"), F.lit(True).alias("member")), "sought", "left")
    check = F.col("check")
    passes = (
        F.when(check == "count", _is_count(F.col("value")))
        .when(check == "count_or_empty", (F.col("value") == "") | _is_count(F.col("value")))
        .when(check == "time", _is_time(F.col("value")))
        .when(check == "member", F.col("member").isNotNull())
        .otherwise(True)
    )
    faults = (
        ruled.where(~F.coalesce(passes, F.lit(False)))
        .groupBy("line_id")
        .agg(F.sort_array(F.collect_set("column")).alias("columns"))
        .select("line_id", F.lit("value").alias("reason"), "columns")
    )
    rejects = broken.unionAll(faults)

    def same_line(a: DataFrame, b: DataFrame) -> Column:
        return a["line_id"].eqNullSafe(b["line_id"])

    bad = faults.select("line_id")
    clean = whole.join(bad, same_line(whole, bad), "left_anti").select(
        "line_id", *(F.nullif(_value(F.col("cells")[k]), F.lit("")).alias(name) for k, name in enumerate(columns))
    )
    return clean, rejects
