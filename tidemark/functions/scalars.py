"""Scalar rules of label files, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(line: Column) -> Column:
    """The blank-separated tokens of a line; an empty array for a blank one, null for null."""
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def number(token: Column) -> Column:
    """A finite decimal number as DOUBLE, null for anything else (suffixed, hexadecimal, NaN and infinite ones too)."""
    return F.when(token.rlike(_NUMBER), token.try_cast("double"))


def class_id(token: Column) -> Column:
    """The integer part of a number; so ``3.0`` is 3 and ``-0.5`` is 0."""
    return number(token).try_cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a wall clock time without zone, in no zone's terms."""
    day = F.unix_date(F.to_date(time)).cast("bigint") * 86_400
    clock = F.hour(time).cast("bigint") * 3600 + F.minute(time) * 60
    return (day + clock) * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
