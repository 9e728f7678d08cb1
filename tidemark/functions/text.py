"""Normal forms of names, keys and file stems, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a placeholder spells, by its letters and digits alone.
PLACEHOLDERS = ("", "unknown", "none", "na", "null", "tbd")
# Picture suffixes that a stem may still carry.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")

_BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))


def strip(text: Column) -> Column:
    """Without blanks of any kind at either end; linear also where blanks fill most of a text."""
    return F.btrim(text, F.lit(_BLANKS))


def word(text: Column) -> Column:
    """A vocabulary word: trimmed, lower case."""
    return F.lower(strip(text))


def spelled(text: Column) -> Column:
    """The letters a-z and digits of a text, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def is_missing(text: Column) -> Column:
    """True for null and for text that spells nothing or a placeholder."""
    return F.coalesce(spelled(text).isin(*PLACEHOLDERS), F.lit(True))


def present(text: Column, value: Column) -> Column:
    """``value`` unless ``text`` is missing, then null."""
    return F.when(~is_missing(text), value)


def key(text: Column) -> Column:
    """A grouping key by its letters and digits; null if the text is missing."""
    return present(text, spelled(text))


def assigned(split: Column) -> Column:
    """A split as a word; null if it is null or blank."""
    return F.nullif(word(split), F.lit(""))


def stem(text: Column) -> Column:
    """A file stem: trimmed, lower case, without one picture suffix; null if nothing is left."""
    bare = F.regexp_replace(word(text), rf"\.({'|'.join(IMAGE_SUFFIXES)})$", "")
    return F.nullif(strip(bare), F.lit(""))
