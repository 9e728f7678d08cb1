"""Samples that match target category proportions.

The divisor method. Rows of a category stand in a random order and row ``k`` has the
priority (k - 1/2) / target share; rows within the minimum of their category come
first, then the globally smallest priorities. A category without further rows offers
none, and its seats fall to the next smallest priorities of the others.

The order inside a category is that of a seeded hash. Ranks are counted over hash
buckets first and then inside each, so a category with a third of all rows is many
tasks. As a category's priorities are fixed by its number of rows, the cut between
kept and left rows is found from the table of targets alone.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.llm.images import valid_classes
from tidemark.operators.ranking import hashed_rank
from tidemark.session import Scratch

BUCKETS = 1024


def categorised(items: DataFrame, classes: DataFrame, domains: DataFrame) -> DataFrame:
    """``item_id, split, category`` of the items with a valid class and a domain.

    The class is the item's valid class that the fewest items have, ties to the smaller
    id; the domain is the item's own, or its dataset's if missing. Null and empty class
    lists, unknown ids and items whose domain cannot be told belong to no category.
    """
    known = domains.groupBy(text.word(F.col("dataset")).alias("dataset")).agg(F.min(text.word(F.col("domain"))).alias("home"))
    rows = (
        items.where(F.col("item_id").isNotNull())
        .select(
            "item_id",
            text.assigned(F.col("split")).alias("split"),
            text.word(F.col("dataset")).alias("dataset"),
            text.present(F.col("domain"), text.word(F.col("domain"))).alias("domain"),
            F.array_distinct("classes").alias("classes"),
        )
        .distinct()
    )
    exploded = rows.select("item_id", "split", "dataset", "domain", F.explode("classes").alias("class_id")).join(valid_classes(classes), "class_id")
    held = exploded.groupBy("class_id").agg(F.count("*").alias("held"))
    rarest = (
        exploded.join(held, "class_id")
        .groupBy("item_id", "split", "dataset", "domain")
        .agg(F.min(F.struct("held", "class_id"))["class_id"].alias("class_id"))
    )
    placed = rarest.join(known, "dataset", "left").withColumn("domain", F.coalesce("domain", "home"))
    return placed.where(F.col("domain").isNotNull() & F.col("split").isNotNull()).select(
        "item_id", "split", F.concat_ws(":", "domain", F.col("class_id").cast("string")).alias("category")
    )


def _smallest(low: list[int], high: list[int], shares: list[float], seats: int) -> list[int]:
    """How many of the ranks ``low < k <= high`` of each category are among the ``seats`` smallest priorities."""
    upto = lambda cut: [min(max(math.floor(cut * t + 0.5), a), b) for a, b, t in zip(low, high, shares, strict=True)]
    room = sum(b - a for a, b in zip(low, high, strict=True))
    if seats >= room:
        return [b - a for a, b in zip(low, high, strict=True)]
    least, most = 0.0, max(((b + 1) / t for b, t in zip(high, shares, strict=True) if t > 0), default=0.0)
    for _ in range(200):
        cut = (least + most) / 2
        if sum(upto(cut)) - sum(low) <= seats:
            least = cut
        else:
            most = cut
    taken = upto(least)
    waiting = [((k + 0.5) / t if t > 0 else math.inf, c, k) for c, (k, b, t) in enumerate(zip(taken, high, shares, strict=True)) if k < b]
    heapq.heapify(waiting)
    for _ in range(seats - (sum(taken) - sum(low))):
        _, c, k = heapq.heappop(waiting)
        taken[c] = k + 1
        if k + 1 < high[c]:
            heapq.heappush(waiting, ((k + 1.5) / shares[c] if shares[c] > 0 else math.inf, c, k + 1))
    return [k - a for k, a in zip(taken, low, strict=True)]


def _allot(request: pd.DataFrame) -> pd.DataFrame:
    """Seats of each category of one request; as many rows as the request has targets."""
    request = request.sort_values("category", kind="stable")
    there = [int(x) for x in request["available"]]
    floors = [min(int(m), n) for m, n in zip(request["min_rows"].fillna(0), there, strict=True)]
    shares = [max(float(t), 0.0) for t in request["target_share"].fillna(0)]
    seats = int(request["sample_size"].fillna(0).max())
    if sum(floors) >= seats:
        drawn = _smallest([0] * len(floors), floors, shares, seats)
    else:
        more = _smallest(floors, there, shares, seats - sum(floors))
        drawn = [f + x for f, x in zip(floors, more, strict=True)]
    return request.assign(drawn=drawn)


def shortfalls(items: DataFrame, classes: DataFrame, domains: DataFrame, targets: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``targets`` with what there is, what is drawn and whether it falls short.

    Columns ``request_id, split, category, target_share, min_rows, sample_size,
    available, drawn, actual_share, short``. ``short``: fewer rows exist than share times
    size (compared to nine decimals, since the product is a rounded binary number)
    or fewer than the minimum. A request whose rows disagree on ``sample_size`` takes the largest.
    """
    scratch = scratch or Scratch(items.sparkSession, "sample")
    there = categorised(items, classes, domains).groupBy("split", "category").agg(F.count("*").alias("available"))
    asked = targets.select("request_id", text.word(F.col("split")).alias("split"), "category", "target_share", "min_rows", "sample_size")
    counted = asked.join(there, ["split", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    shape = "request_id int, split string, category string, target_share double, min_rows int, sample_size int, available bigint, drawn bigint"
    columns = [c.split()[0] for c in shape.split(", ")]
    allotted = counted.groupBy("request_id").applyInPandas(lambda x: _allot(x)[columns], shape)
    size = F.sum("drawn").over(Window.partitionBy("request_id"))
    short = (F.col("available") < F.round(F.col("target_share") * F.col("sample_size"), 9)) | (F.col("available") < F.col("min_rows"))
    return scratch.save(
        allotted.withColumn("actual_share", F.coalesce(F.try_divide(F.col("drawn").cast("double"), size), F.lit(0.0))).withColumn("short", F.coalesce(short, F.lit(False))), "report"
    )


def draw(items: DataFrame, classes: DataFrame, domains: DataFrame, targets: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``request_id, category, item_id, place, priority`` of the drawn rows.

    The order of a category is the same for every request, so a larger request of the
    same shares contains the smaller one. Empty tables give an empty sample.
    """
    scratch = Scratch(items.sparkSession, "sample")
    report = shortfalls(items, classes, domains, targets, scratch)
    rows = scratch.save(categorised(items, classes, domains), "rows")
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id")))
    ranked = hashed_rank(rows, ["split", "category"], drawn, "item_id", buckets=buckets)
    seats = report.where(F.col("drawn") > 0).select("request_id", "split", "category", "target_share", "drawn")
    kept = ranked.join(seats, ["split", "category"]).where(F.col("place") <= F.col("drawn"))
    return scratch.finish(
        kept.select("request_id", "category", "item_id", "place", F.try_divide(F.col("place") - 0.5, F.col("target_share")).alias("priority"))
    )
