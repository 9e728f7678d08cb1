"""Perceptual hashes of decoded luminance, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import bits

SIDE = 32
KEPT = 8


def cosine_basis(n: int) -> np.ndarray:
    """The orthonormal type-II cosine transform of ``n`` samples as a matrix."""
    k, x = np.mgrid[0:n, 0:n]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def low_frequencies(luminance: np.ndarray) -> np.ndarray:
    """The 64 lowest coefficients of a 32 x 32 picture, constant term included, row by row."""
    basis = cosine_basis(SIDE)[:KEPT]
    return (basis @ luminance.reshape(SIDE, SIDE) @ basis.T).ravel()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def coefficients(luminance: pd.Series) -> pd.Series:
    """The coefficients of arrays of 1024 grey values; null for any other length."""
    return luminance.map(lambda v: None if v is None or len(v) != SIDE * SIDE else low_frequencies(np.asarray(v, float)))


def above_median(values: Column) -> Column:
    """Bits of 64 values: which are greater than their median, the first as the highest bit."""
    ordered = F.array_sort(F.transform(values, lambda v: v.cast("double")))
    middle = (ordered[31] + ordered[32]) / 2
    return F.when(F.size(values) == 64, bits.pack(F.transform(values, lambda v: v.cast("double") > middle)))


def with_phash(pictures: DataFrame, luminance: str, name: str = "hash") -> DataFrame:
    """``pictures`` with the 64-bit perceptual hash of a column of 32 x 32 grey values, null for any other length."""
    found = pictures.withColumn("_coefficients", coefficients(F.col(luminance)))
    return found.withColumn(name, above_median(F.col("_coefficients"))).drop("_coefficients")
