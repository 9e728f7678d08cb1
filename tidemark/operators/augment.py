"""Planning of copy-paste augmentation: which instance goes where. Pixels are left to the writer of pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import CORNERS, iou
from tidemark.functions.scalars import let
from tidemark.operators.neardup import reject_near
from tidemark.operators.ranking import hashed_rank
from tidemark.session import Scratch

SYNTHETIC = r"^aug(cp|os|xd)_"


def is_synthetic(stem: Column) -> Column:
    """Whether a stem names a generated picture."""
    return F.coalesce(stem.rlike(SYNTHETIC), F.lit(False))


def instances(boxes: DataFrame, military: list[int], least: float = 4.0) -> DataFrame:
    """The military boxes with both sides of at least ``least`` pixels."""
    return boxes.where(F.col("class_id").isin(*military) & (F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) drawn from an md5 of the parts."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def plan_pastes(
    found: DataFrame, backgrounds: DataFrame, existing: DataFrame, width: float, height: float, low: float = 0.08, high: float = 0.30,
    tries: int = 20, most_overlap: float = 0.3, seed: int = 42, most: int = 3, copies: int | None = None, band: tuple[float, float] | None = None, prefix: str = "augcp_",
) -> DataFrame:
    """``stem, crop_no, instance_id, background_id, flip, x1, y1, x2, y2``: the crops placed in each of ``copies`` generated pictures.

    A picture has a drawn domain of those with instances and backgrounds, a background (``image_id, domain``) and one to ``most``
    instances (``instance_id, domain`` and corners) of it, drawn by places in hashed orders. Each crop is scaled to a drawn share of the
    width and put at the first of ``tries`` drawn places where it overlaps neither an ``existing`` box (``image_id`` and corners) of the
    background nor a crop placed before by ``most_overlap`` or more; it is left out if there is none. ``copies`` is the number of instances
    unless given. With ``band`` the crops lie between these shares of the height, if they fit there.
    """
    scratch = Scratch(found.sparkSession, "pastes")
    found = scratch.save(found.select("instance_id", "domain", *CORNERS), "found")
    backgrounds = scratch.save(backgrounds.select("image_id", "domain"), "backgrounds")
    salt = F.lit(f"{seed}|{prefix}")
    at = lambda size, *parts: (F.floor(unit(salt, *parts) * size) + 1).cast("bigint")
    ranked = lambda t, key: hashed_rank(t, ["domain"], F.md5(F.concat_ws("|", salt, F.col(key).cast("string"))), key)

    sizes = found.groupBy("domain").agg(F.count("*").alias("instances")).join(backgrounds.groupBy("domain").agg(F.count("*").alias("pictures")), "domain")
    # A row for each domain.
    domains = sizes.withColumn("domain_no", F.row_number().over(Window.orderBy("domain")).cast("bigint")).withColumn("domains", F.count("*").over(Window.partitionBy()))
    number = found.sparkSession.range(found.count() if copies is None else copies).withColumnRenamed("id", "picture")
    drawn = number.join(domains.select("domains").limit(1).withColumn("one", F.lit(1)), F.col("one") == 1).withColumn("domain_no", at(F.col("domains"), F.lit("domain"), "picture")).drop("one", "domains")
    drawn = drawn.join(domains, "domain_no").withColumn("place", at(F.col("pictures"), F.lit("bg"), "picture"))
    pictures = drawn.join(ranked(backgrounds, "image_id"), ["domain", "place"]).select("picture", "domain", "instances", F.col("image_id").alias("background_id"))

    wanted = pictures.withColumn("crop_no", F.explode(F.sequence(F.lit(1).cast("bigint"), at(F.lit(most), F.lit("n"), "picture"))))
    crops = wanted.withColumn("place", at(F.col("instances"), F.lit("crop"), "picture", "crop_no")).join(ranked(found, "instance_id"), ["domain", "place"])
    side = lambda lo, hi: F.col(hi).cast("bigint") - F.col(lo).cast("bigint")
    share = F.lit(low) + unit(salt, F.lit("w"), "picture", "crop_no") * (high - low)
    sized = crops.withColumn("cw", side("x1", "x2")).withColumn("ch", side("y1", "y2")).where((F.col("cw") >= 2) & (F.col("ch") >= 2))
    sized = sized.withColumn("nw", F.greatest(F.lit(2), F.floor(share * width))).withColumn("nh", F.greatest(F.lit(2), F.floor(share * width * F.col("ch") / F.col("cw"))))
    fits = sized.where((F.col("nw") < width) & (F.col("nh") < height)).withColumn("flip", unit(salt, F.lit("flip"), "picture", "crop_no") < 0.5)
    several = fits.groupBy("picture", "background_id").agg(F.sort_array(F.collect_list(F.struct("crop_no", "instance_id", "flip", "nw", "nh"))).alias("crops"))
    held = existing.groupBy(F.col("image_id").alias("background_id")).agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in CORNERS))).alias("held"))
    around = several.join(held, "background_id", "left")

    boxes = held.schema["held"].dataType
    placed = f"array<struct<crop_no: bigint, instance_id: {found.schema['instance_id'].dataType.simpleString()}, flip: boolean, b: {boxes.elementType.simpleString()}>>"

    def first_free(crop: Column, taken: Column) -> Column:
        least, room = F.lit(0), F.lit(int(height)) - crop["nh"]
        if band is not None:
            top, end = F.lit(int(band[0] * height)), F.lit(int(band[1] * height)) - crop["nh"]
            least, room = F.when(end > top, top).otherwise(least), F.when(end > top, end - top).otherwise(room)
        draw = lambda k, axis, span: F.floor(unit(salt, F.lit(axis), F.col("picture").cast("string"), crop["crop_no"].cast("string"), k.cast("string")) * (span + 1))

        def box(k: Column) -> Column:
            x, y = draw(k, "x", F.lit(int(width)) - crop["nw"]), least + draw(k, "y", room)
            return F.struct(*(v.cast("double").alias(n) for n, v in zip(CORNERS, (x, y, x + crop["nw"], y + crop["nh"]))))

        # Nothing is drawn once a place is found.
        free = lambda b: F.when(F.forall(taken, lambda e: iou(b, e) < most_overlap), b)
        return F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast(boxes.elementType), lambda b, k: F.when(b.isNotNull(), b).otherwise(let(box(k), free)))

    def put(done: Column, crop: Column) -> Column:
        one = lambda b: F.struct(crop["crop_no"].alias("crop_no"), crop["instance_id"].alias("instance_id"), crop["flip"].alias("flip"), b.alias("b"))
        more = lambda b: F.struct(F.array_append(done["held"], b).alias("held"), F.array_append(done["placed"], one(b)).alias("placed"))
        return let(first_free(crop, done["held"]), lambda b: F.when(b.isNull(), done).otherwise(more(b)))

    start = F.struct(F.coalesce("held", F.array().cast(boxes)).alias("held"), F.array().cast(placed).alias("placed"))
    put_all = around.select("picture", "background_id", F.explode(F.aggregate("crops", start, put)["placed"]).alias("p"))
    stem = F.format_string(f"{prefix}%05d", "picture").alias("stem")
    return scratch.finish(put_all.select(stem, "p.crop_no", "p.instance_id", "background_id", "p.flip", *(F.col("p.b")[c].alias(c) for c in CORNERS)))


def plan_cross_domain(
    found: DataFrame, backgrounds: DataFrame, existing: DataFrame, width: float, height: float, source: str = "aerial", target: str = "surface",
    copies: int = 300, most: int = 2, seed: int = 42, tag: str = "surface_synth",
) -> DataFrame:
    """As ``plan_pastes``, and ``domain``: instances of the source domain, small and around the horizon, on backgrounds of the target domain.

    The pictures count as ``tag``. Once they are composed and hashed, ``without_leaks`` drops those too near to held-out ones.
    """
    moved = found.where(F.col("domain") == source).withColumn("domain", F.lit(target))
    onto = backgrounds.where(F.col("domain") == target)
    plan = plan_pastes(moved, onto, existing, width, height, 0.04, 0.16, 25, seed=seed, most=most, copies=copies, band=(0.35, 0.80), prefix="augxd_")
    return plan.withColumn("domain", F.lit(tag))


def without_leaks(plan: DataFrame, composed: DataFrame, holdout: DataFrame, threshold: int = 5) -> DataFrame:
    """The rows of ``plan`` whose composed picture (``stem, hash``) is within the threshold of no hash of ``holdout``; without a row there a picture is dropped."""
    return reject_near(plan.join(composed.select("stem", "hash"), "stem"), holdout, threshold).select(*plan.columns)


def update_domains(current: DataFrame, added: DataFrame) -> DataFrame:
    """``stem, domain``: the current map without old synthetic stems, and the added ones, which win."""
    kept = current.where(~is_synthetic(F.col("stem")))
    joined = kept.alias("c").join(added.alias("a"), F.col("c.stem") == F.col("a.stem"), "full")
    return joined.select(F.coalesce("a.stem", "c.stem").alias("stem"), F.coalesce("a.domain", "c.domain").alias("domain"))
