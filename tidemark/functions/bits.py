"""Columns over 64-bit perceptual hashes held as signed BIGINT bit patterns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(pattern: int) -> int:
    """The BIGINT of an unsigned 64-bit pattern."""
    return pattern - (1 << 64) if pattern >> 63 else pattern


def real(value: Column) -> Column:
    """The hash, or null where the picture could not be hashed (null or 0)."""
    return F.when(value != 0, value)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def band(value: Column, index: int, width: int = 8) -> Column:
    """Band ``index`` of ``width`` bits, counted from the low end."""
    return F.shiftrightunsigned(value, index * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def hex16(value: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def pack(flags: Column) -> Column:
    """An array of 64 booleans, most significant first, as a BIGINT."""
    return F.aggregate(flags, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("bigint")))


def cuts(positions: list[int], parts: int) -> list[list[int]]:
    """Bit positions in ``parts`` runs whose lengths differ by at most one."""
    size, rest = divmod(len(positions), parts)
    runs, at = [], 0
    for k in range(parts):
        end = at + size + (k < rest)
        runs.append(positions[at:end])
        at = end
    return runs


def masks(positions: list[int], parts: int, agree: int) -> list[int]:
    """A mask for each choice of ``agree`` of the ``parts`` runs of these positions."""
    runs = cuts(positions, parts)
    return [sum(1 << p for run in chosen for p in run) for chosen in combinations(runs, agree)]


def first_mask(xor: Column, choices: list[int]) -> Column:
    """Index of the first mask under which nothing differs; null if there is none."""
    found = F.when(xor.bitwiseAND(F.lit(signed(choices[0]))) == 0, F.lit(0))
    for k, mask in enumerate(choices[1:], 1):
        found = found.when(xor.bitwiseAND(F.lit(signed(mask))) == 0, F.lit(k))
    return found
