"""Scoring of detections against ground truth.

Predictions of one image and class take ground truth greedily in the order of falling
confidence, each the best box not yet taken. Whether a prediction is right depends only on those
before it, so one matching at the lowest confidence serves every threshold: the counts at a
threshold are those of the flags at or above it. The matching is an array fold within the
JVM; the arrays are the boxes of one class in one image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geometry import CORNERS, iou, let
from tidemark.functions.scalars import ratio

KEY = ["image_id", "class_id"]


def match(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``image_id, class_id, box_idx, conf, hit, truth_idx`` of every prediction.

    ``truth``: ``image_id, class_id, box_idx`` and corners; ``predictions`` also ``conf``. Equal confidences
    follow ``box_idx``; of equally good boxes the first by ``box_idx`` is taken; a match at
    exactly the threshold counts. A prediction without ground truth is no hit.
    """
    corners = F.struct(*(F.col(c).cast("double").alias(c) for c in CORNERS)).alias("box")
    t = truth.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("box_idx", corners))).alias("truths"))
    p = predictions.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("rank"), "box_idx", "conf", corners))).alias("preds"))
    grouped = p.join(t, KEY, "left").withColumn("truths", F.coalesce("truths", F.array().cast(t.schema["truths"].dataType)))
    kind = dict(predictions.dtypes)["box_idx"]
    start = F.struct(
        F.array().cast("array<int>").alias("used"),
        F.array().cast(f"array<struct<box_idx: {kind}, conf: double, hit: boolean, at: int>>").alias("flags"),
    )

    def take(state, pred):
        overlaps = F.transform("truths", lambda g, i: F.when(F.array_contains(state["used"], i), F.lit(-1.0)).otherwise(iou(pred["box"], g["box"])))
        place = lambda o, best: F.when(best >= threshold, (F.array_position(o, best) - 1).cast("int"))

        def step(at):
            flag = F.struct(pred["box_idx"].alias("box_idx"), pred["conf"].cast("double").alias("conf"), at.isNotNull().alias("hit"), at.alias("at"))
            return F.struct(F.when(at.isNotNull(), F.array_append(state["used"], at)).otherwise(state["used"]).alias("used"), F.array_append(state["flags"], flag).alias("flags"))

        return let(let(overlaps, lambda o: let(F.array_max(o), lambda best: place(o, best))), step)

    folded = grouped.select(*KEY, "truths", F.aggregate("preds", start, take)["flags"].alias("flags"))
    flat = folded.select(*KEY, "truths", F.explode("flags").alias("f"))
    return flat.select(*KEY, "f.box_idx", "f.conf", "f.hit", F.get("truths", F.col("f.at"))["box_idx"].alias("truth_idx"))


def sweep(flags: DataFrame, truth: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """``conf, tp, fp, fn, recall, precision`` at each threshold, in one pass over the flags."""
    spark = flags.sparkSession
    cuts = F.array(*(F.lit(t) for t in thresholds))
    reached = flags.select("hit", "conf", F.explode(cuts).alias("cut")).where(F.col("conf") >= F.col("cut"))
    counted = reached.groupBy("cut").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    rows = spark.createDataFrame([(t, 1) for t in thresholds], "cut double, one int")
    total = truth.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    full = rows.join(counted, "cut", "left").join(total, "one").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tp", "fp")})
    full = full.withColumn("fn", F.col("n") - F.col("tp"))
    tp = F.col("tp")
    return full.select(F.col("cut").alias("conf"), "tp", "fp", "fn", ratio(tp, tp + F.col("fn")).alias("recall"), ratio(tp, tp + F.col("fp")).alias("precision"))


def precision_recall(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """``class_id, conf, tp, fp, recall, precision``: the curve of each class at every confidence a prediction has.

    Running sums go over ranges of confidence first and then inside each, so that no task holds a whole class.
    """
    counted = flags.groupBy("class_id", "conf").agg(F.count_if("hit").alias("t"), F.count_if(~F.col("hit")).alias("f")).withColumn("range", F.floor(F.col("conf") * 1000))
    down = Window.partitionBy("class_id").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.groupBy("class_id", "range").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    before = before.select("class_id", "range", *(F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_before") for c in "tf"))
    inside = Window.partitionBy("class_id", "range").orderBy(F.desc("conf"))
    run = counted.join(before, ["class_id", "range"]).select("class_id", "conf", (F.sum("t").over(inside) + F.col("t_before")).alias("tp"), (F.sum("f").over(inside) + F.col("f_before")).alias("fp"))
    joined = run.join(truth.groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left")
    return joined.select("class_id", "conf", "tp", "fp", ratio(F.col("tp"), F.coalesce("n", F.lit(0))).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def recall_table(flags: DataFrame, truth: DataFrame, domains: DataFrame, military: list[int], conf_military: float = 0.10, conf: float = 0.25) -> DataFrame:
    """``part, domain, class_id, tp, fn, recall`` by domain and class, class, domain (military) and overall (military).

    A class counts its hits from its own threshold on. Parts without ground truth have no row; an image
    without a domain is ``unknown``. ``truth`` and ``flags`` are summed by image and class before the domains are joined.
    """
    special = F.col("class_id").isin(*military)
    counted = flags.where("hit").where(F.col("conf") >= F.when(special, conf_military).otherwise(conf)).groupBy(*KEY).agg(F.count("*").alias("tp"))
    per = truth.groupBy(*KEY).agg(F.count("*").alias("n")).join(counted, KEY, "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    placed = per.join(domains.select("image_id", "domain"), "image_id", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    base = placed.groupBy("domain", "class_id").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    both = base.withColumn("mil", special)
    grouped = both.groupingSets([["domain", "class_id"], ["class_id"], ["domain", "mil"], ["mil"]], "domain", "class_id", "mil").agg(
        F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.grouping_id("domain", "class_id", "mil").alias("g")
    )
    part = F.when(F.col("g") == 1, "domain_class").when(F.col("g") == 5, "class").when(F.col("g") == 2, "domain").when(F.col("g") == 6, "overall")
    kept = grouped.withColumn("part", part).where(F.col("part").isin("domain_class", "class") | F.col("mil"))
    return kept.select("part", "domain", "class_id", "tp", (F.col("n") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("n")).alias("recall"))


def gate(recalls: DataFrame, least: float = 0.90) -> DataFrame:
    """``min_recall, passed`` over rows with ``recall``; without any the minimum is null and the gate fails."""
    return recalls.agg(F.min("recall").alias("min_recall")).withColumn("passed", F.coalesce(F.col("min_recall") >= least, F.lit(False)))


def outcomes(truth: DataFrame, predictions: DataFrame, flags: DataFrame, conf: float = 0.10, threshold: float = 0.5) -> DataFrame:
    """``outcome, n`` of ground truth boxes: found, low_confidence, mislabelled or never_seen.

    Found: matched at or above ``conf``. Low confidence: matched below it. Mislabelled: not matched, but a prediction of another
    class overlaps it by the threshold. The join is on the image.
    """
    matched = flags.where("hit").select("image_id", "class_id", F.col("truth_idx").alias("box_idx"), F.col("conf").alias("by"))
    known = truth.join(matched, ["image_id", "class_id", "box_idx"], "left")
    box = lambda: F.struct(*(F.col(c).cast("double").alias(c) for c in CORNERS))
    lost = known.where(F.col("by").isNull()).select("image_id", "class_id", "box_idx", box().alias("t"))
    other = predictions.select("image_id", F.col("class_id").alias("said"), box().alias("p"))
    wrong = lost.join(other, "image_id").where((F.col("said") != F.col("class_id")) & (iou(F.col("p"), F.col("t")) >= threshold))
    wrong = wrong.select("image_id", "class_id", "box_idx").distinct().withColumn("wrong", F.lit(True))
    judged = known.join(wrong, ["image_id", "class_id", "box_idx"], "left")
    outcome = F.when(F.col("by") >= conf, "found").when(F.col("by").isNotNull(), "low_confidence").when(F.col("wrong"), "mislabelled").otherwise("never_seen")
    return judged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def median_short_side(truth: DataFrame) -> DataFrame:
    """``class_id, median_side`` in pixels.

    Boxes are counted by whole pixels first; only those in the pixels that hold the middle ranks are sorted.
    """
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    rows = truth.select("class_id", side.alias("side")).where(F.col("side").isNotNull()).withColumn("pixel", F.floor("side"))
    held = rows.groupBy("class_id", "pixel").agg(F.count("*").alias("held"))
    own = Window.partitionBy("class_id")
    before = F.coalesce(F.sum("held").over(own.orderBy("pixel").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("held").over(own)
    middle = held.select("class_id", "pixel", "held", before.alias("before"), F.floor((total + 1) / 2).alias("low"), (F.floor(total / 2) + 1).alias("high"))
    middle = middle.where((F.col("before") < F.col("high")) & (F.col("before") + F.col("held") >= F.col("low"))).drop("held")
    place = F.row_number().over(Window.partitionBy("class_id", "pixel").orderBy("side")) + F.col("before")
    chosen = rows.join(middle, ["class_id", "pixel"]).withColumn("place", place).where((F.col("place") == F.col("low")) | (F.col("place") == F.col("high")))
    return chosen.groupBy("class_id").agg(F.round(F.avg("side"), 6).alias("median_side"))


def training_counts(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``part, split, class_id, n``: the images of each split (``part`` is ``images``), with or without labels, and the instances of each class in it.

    ``images``: ``image_id, split``; ``labels``: ``image_id, class_id``, one row a box. Images without a split and labels of no such image count nowhere.
    """
    placed = images.where(F.col("split").isNotNull()).select("image_id", "split")
    pictures = placed.groupBy("split").agg(F.count("*").alias("n")).select(F.lit("images").alias("part"), "split", F.lit(None).cast("int").alias("class_id"), "n")
    found = labels.where(F.col("class_id").isNotNull()).join(placed, "image_id").groupBy("split", "class_id").agg(F.count("*").alias("n"))
    return pictures.unionAll(found.select(F.lit("instances").alias("part"), "split", F.col("class_id").cast("int").alias("class_id"), "n"))


def trainable(counts: DataFrame, military: list[int], split: str = "train") -> DataFrame:
    """``military_in_train, passed``: training without one military instance can never pass the gate on their recall."""
    own = (F.col("part") == "instances") & (F.col("split") == split) & F.col("class_id").isin(*military)
    total = counts.agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("military_in_train"))
    return total.withColumn("passed", F.col("military_in_train") > 0)
