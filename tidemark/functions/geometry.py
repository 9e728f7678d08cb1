"""Box geometry as Column expressions; a box is four columns or a struct of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import let

CORNERS = ("x1", "y1", "x2", "y2")


def to_pixels(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in pixels of a normalized box."""
    return {
        "x1": (cx - w / 2) * width,
        "y1": (cy - h / 2) * height,
        "x2": (cx + w / 2) * width,
        "y2": (cy + h / 2) * height,
    }


def clamp(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Ordered corners within the picture as a struct; null if no area is left."""
    within = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    box = F.struct(
        within(F.least(x1, x2), width).alias("x1"), within(F.least(y1, y2), height).alias("y1"),
        within(F.greatest(x1, x2), width).alias("x2"), within(F.greatest(y1, y2), height).alias("y2"),
    )
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def to_normalized(box: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size of a pixel box as shares of the picture."""
    return {
        "cx": (box["x1"] + box["x2"]) / 2 / width,
        "cy": (box["y1"] + box["y2"]) / 2 / height,
        "w": (box["x2"] - box["x1"]) / width,
        "h": (box["y2"] - box["y1"]) / height,
    }


def _around(coords: Column) -> Column:
    def box(xs: Column, ys: Column) -> Column:
        return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))

    return let(F.filter(coords, lambda v, i: i % 2 == 0), lambda xs: let(F.filter(coords, lambda v, i: i % 2 == 1), lambda ys: box(xs, ys)))


def envelope(coords: Column) -> Column:
    """The upright box around a flat ``x, y, x, y, ...`` array; null with fewer than three points, an odd count or a null."""
    whole = (F.size(coords) >= 6) & (F.size(coords) % 2 == 0) & F.forall(coords, lambda v: v.isNotNull())
    return F.when(whole, _around(coords))


def yolo_shape(coords: Column) -> Column:
    """A normalized ``cx, cy, w, h`` struct of label coordinates: four as they are, a polygon as its envelope within the picture."""
    unit = F.transform(coords, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    plain = F.struct(coords[0].alias("cx"), coords[1].alias("cy"), coords[2].alias("w"), coords[3].alias("h"))

    def centred(box: Column) -> Column:
        return F.struct(
            ((box["x1"] + box["x2"]) / 2).alias("cx"), ((box["y1"] + box["y2"]) / 2).alias("cy"),
            (box["x2"] - box["x1"]).alias("w"), (box["y2"] - box["y1"]).alias("h"),
        )

    polygon = (F.size(coords) >= 6) & (F.size(coords) % 2 == 0)
    return F.when(F.size(coords) == 4, plain).when(polygon, let(unit, lambda u: let(_around(u), centred)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 where the union has no area."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda v: F.greatest(F.lit(0.0), v["x2"] - v["x1"]) * F.greatest(F.lit(0.0), v["y2"] - v["y1"])
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
