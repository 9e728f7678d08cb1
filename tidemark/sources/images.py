"""Sizes of pictures from their headers; pixels are not decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of PNG, JPEG, GIF and BMP data; null for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                return None
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """The size of each picture as a struct of nulls where it cannot be read."""
    sizes = [header_size(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame({"width": pd.array([s[0] if s else None for s in sizes], "Int32"), "height": pd.array([s[1] if s else None for s in sizes], "Int32")})
