"""Queries over detections: matching, recall, logs and streams, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geometry import CORNERS, iou
from tidemark.operators import detections, evaluate
from tidemark.plans import views
from tidemark.plans.views import BOXES, ITEMS, PREDICTIONS, TRUTH, sql_iou
from tidemark.session import Scratch
from tidemark.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SWEEP = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)


def query(sql: str | None = None):
    """Register a query under the name of its function."""

    def wrap(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return wrap


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.match(views.truth(spark, folder), views.predictions(spark, folder))


# One step a rank: the prediction of that rank takes the best box its image and class have left.
_MATCH = f"""{PREDICTIONS},
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY conf DESC, box_idx) AS k FROM pr),
ov AS MATERIALIZED (SELECT p.image_id, p.class_id, p.k, t.box_idx AS tb, {sql_iou('p', 't')} AS o FROM rk p JOIN tr t ON t.image_id = p.image_id AND t.class_id = p.class_id),
st AS (SELECT image_id, class_id, 0::BIGINT AS k, []::INT[] AS used, NULL::INT AS truth_idx FROM (SELECT DISTINCT image_id, class_id FROM rk)
  UNION ALL
  SELECT image_id, class_id, k, CASE WHEN tb IS NULL THEN used ELSE list_append(used, tb) END, tb FROM (
    SELECT s.image_id, s.class_id, r.k, s.used, (SELECT arg_min(v.tb, (-v.o, v.tb)) FROM ov v WHERE v.image_id = s.image_id AND v.class_id = s.class_id AND v.k = r.k AND v.o >= 0.5 AND NOT list_contains(s.used, v.tb)) AS tb
    FROM st s JOIN rk r ON r.image_id = s.image_id AND r.class_id = s.class_id AND r.k = s.k + 1)),
fl AS MATERIALIZED (SELECT r.image_id, r.class_id, r.box_idx, r.conf, s.truth_idx IS NOT NULL AS hit, s.truth_idx FROM st s JOIN rk r ON r.image_id = s.image_id AND r.class_id = s.class_id AND r.k = s.k)"""


@query(f"WITH {PREDICTIONS} SELECT p.image_id, p.class_id, p.box_idx AS pred_idx, t.box_idx AS truth_idx, round({sql_iou('p', 't')}, 6) AS iou FROM pr p JOIN tr t ON t.image_id = p.image_id AND t.class_id = p.class_id WHERE {sql_iou('p', 't')} > 0")
def q27_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    box = F.struct(*CORNERS)
    t = views.truth(spark, folder).select("image_id", "class_id", F.col("box_idx").alias("truth_idx"), box.alias("t"))
    p = views.predictions(spark, folder).select("image_id", "class_id", F.col("box_idx").alias("pred_idx"), box.alias("p"))
    met = p.join(t, ["image_id", "class_id"]).withColumn("iou", iou(F.col("p"), F.col("t"))).where(F.col("iou") > 0)
    return met.select("image_id", "class_id", "pred_idx", "truth_idx", F.round("iou", 6).alias("iou"))


@query(f"WITH RECURSIVE {_MATCH} SELECT * FROM fl")
def q28_match_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _flags(spark, folder)


@query(f"""WITH RECURSIVE {_MATCH}, c(conf) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in SWEEP)}), n AS (SELECT count(*) AS n FROM tr),
s AS (SELECT c.conf, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM c LEFT JOIN fl ON fl.conf >= c.conf GROUP BY c.conf)
SELECT conf, tp, fp, n - tp AS fn, round(tp / n, 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM s, n""")
def q29_sweep(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.sweep(_flags(spark, folder), views.truth(spark, folder), SWEEP)
    return found.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


@query(f"""WITH RECURSIVE {_MATCH}, n AS (SELECT class_id, count(*) AS n FROM tr GROUP BY class_id),
b AS (SELECT class_id, conf, count(*) FILTER (hit) AS t, count(*) FILTER (NOT hit) AS f FROM fl GROUP BY ALL),
r AS (SELECT class_id, conf, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM b WINDOW w AS (PARTITION BY class_id ORDER BY conf DESC))
SELECT r.class_id, conf, tp::BIGINT AS tp, fp::BIGINT AS fp, round(coalesce(tp / n, 0), 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM r LEFT JOIN n ON n.class_id = r.class_id""")
def q29b_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluate.precision_recall(_flags(spark, folder), views.truth(spark, folder))
    return found.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


_RECALL = f"""{_MATCH}, {ITEMS},
h AS (SELECT image_id, class_id, count(*) AS tp FROM fl WHERE hit AND conf >= CASE WHEN class_id = 7 THEN 0.10 ELSE 0.25 END GROUP BY ALL),
g AS (SELECT image_id, class_id, count(*) AS n FROM tr GROUP BY ALL),
d AS (SELECT coalesce(it.domain, 'unknown') AS domain, g.class_id, n, coalesce(h.tp, 0) AS tp FROM g LEFT JOIN h ON h.image_id = g.image_id AND h.class_id = g.class_id LEFT JOIN it ON it.item_id = g.image_id),
rc AS (SELECT 'domain_class' AS part, domain, class_id, sum(tp) AS tp, sum(n) AS n FROM d GROUP BY domain, class_id
 UNION ALL SELECT 'class', NULL, class_id, sum(tp), sum(n) FROM d GROUP BY class_id
 UNION ALL SELECT 'domain', domain, NULL, sum(tp), sum(n) FROM d WHERE class_id = 7 GROUP BY domain
 UNION ALL SELECT 'overall', NULL, NULL, sum(tp), sum(n) FROM d WHERE class_id = 7 HAVING count(*) > 0)"""


def _recalls(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.recall_table(_flags(spark, folder), views.truth(spark, folder), views.image_domains(spark, folder), views.MILITARY)


@query(f"WITH RECURSIVE {_RECALL} SELECT part, domain, class_id, tp::BIGINT AS tp, (n - tp)::BIGINT AS fn, round(tp / n, 9)::DOUBLE AS recall FROM rc")
def q30_recall_table(spark: SparkSession, folder: str) -> DataFrame:
    return _recalls(spark, folder).withColumn("recall", F.round("recall", 9))


@query(f"WITH RECURSIVE {_RECALL} SELECT round(min(tp / n), 9)::DOUBLE AS min_recall, coalesce(min(tp / n) >= 0.9, false) AS passed FROM rc WHERE part = 'class' AND class_id = 7")
def q31_gate(spark: SparkSession, folder: str) -> DataFrame:
    own = _recalls(spark, folder).where((F.col("part") == "class") & F.col("class_id").isin(*views.MILITARY))
    return evaluate.gate(own).withColumn("min_recall", F.round("min_recall", 9))


@query(f"""WITH RECURSIVE {_MATCH}, m AS (SELECT t.*, f.conf AS got FROM tr t LEFT JOIN fl f ON f.hit AND f.image_id = t.image_id AND f.class_id = t.class_id AND f.truth_idx = t.box_idx),
o AS (SELECT CASE WHEN got >= 0.1 THEN 'found' WHEN got IS NOT NULL THEN 'low_confidence' WHEN EXISTS (SELECT 1 FROM pr p WHERE p.image_id = t.image_id AND p.class_id <> t.class_id AND {sql_iou('p', 't')} >= 0.5) THEN 'mislabelled' ELSE 'never_seen' END AS outcome FROM m t)
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def q32_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.outcomes(views.truth(spark, folder), views.predictions(spark, folder), _flags(spark, folder))


@query(f"WITH {TRUTH} SELECT class_id, round(quantile_cont(least(x2 - x1, y2 - y1), 0.5), 6) AS median_side FROM tr GROUP BY class_id")
def q32b_median_side(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.median_short_side(views.truth(spark, folder))


_GROUP_OF = "CASE event_type WHEN 'purchase' THEN 'military' WHEN 'signup' THEN 'small_craft' WHEN 'error' THEN 'other' ELSE 'civilian' END"
_EVENTS = f"""ev AS (SELECT event_id, ts, user_id, event_type, {_GROUP_OF} AS grp, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 500)) AS confidence FROM events)"""


def _detections(spark: SparkSession, folder: str) -> DataFrame:
    """Events seen as detections: the frame is the event, the track the user."""
    kind = F.col("event_type")
    group = F.when(kind == "purchase", "military").when(kind == "signup", "small_craft").when(kind == "error", "other").otherwise("civilian")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500))
    return views.table(spark, folder, "events").select(F.col("event_id").alias("frame"), "ts", F.col("user_id").alias("track_id"), kind.alias("class_name"), group.alias("group"), confidence.alias("confidence"))


@query(f"WITH {_EVENTS} SELECT event_id AS frame, event_type AS class_name, round(confidence, 6) AS confidence FROM ev WHERE confidence >= CASE WHEN grp = 'military' THEN 0.10 ELSE 0.25 END")
def q35_kept_detections(spark: SparkSession, folder: str) -> DataFrame:
    return detections.keep(_detections(spark, folder)).select("frame", "class_name", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_EVENTS} SELECT event_id AS id, event_type AS class, round(confidence, 6) AS confidence, (event_id % 1000)::DOUBLE AS x1, event_id::INT AS frame, round(event_id / 25.0::DOUBLE, 3) AS \"timestamp\" FROM ev")
def q36_wire_records(spark: SparkSession, folder: str) -> DataFrame:
    """Detections written as JSON and read back."""
    rows = _detections(spark, folder)
    bbox = F.array(*((F.col("frame") % 1000 + k).cast("double") for k in range(4)))
    wire = detections.to_wire(F.col("class_name"), F.round("confidence", 6), bbox, F.col("frame").cast("int"), F.round(F.col("frame") / 25.0, 3))
    back = rows.select(F.col("frame").alias("id"), detections.from_wire(wire).alias("d"))
    return back.select("id", F.col("d.class").alias("class"), "d.confidence", F.col("d.bbox")[0].alias("x1"), "d.frame", "d.timestamp")


@query(f"""WITH {_EVENTS} SELECT event_id AS frame, round(event_id / 25.0::DOUBLE, 3) AS timestamp_s, CASE WHEN grp <> 'other' THEN user_id END AS track_id, event_type AS class, grp AS "group", round(confidence, 4) AS confidence,
  (event_id % 1000)::DOUBLE AS x1, (event_id % 700)::DOUBLE AS y1, (event_id % 1000 + 50.5)::DOUBLE AS x2, (event_id % 700 + 20.5)::DOUBLE AS y2 FROM ev""")
def q37_detection_log(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("frame")
    boxed = _detections(spark, folder).withColumns({
        "timestamp_s": n / 25.0, "track_id": F.when(F.col("group") != "other", F.col("track_id")),
        "x1": (n % 1000).cast("double"), "y1": (n % 700).cast("double"), "x2": n % 1000 + F.lit(50.5), "y2": n % 700 + F.lit(20.5),
    })
    return detections.log_rows(boxed)


@query(f"""WITH {_EVENTS}, g(grp) AS (VALUES ('civilian'), ('small_craft'), ('military'), ('other'), ('unseen'))
SELECT g.grp AS "group", count(event_id) AS n, coalesce(round(avg(confidence), 6), 0) AS mean_confidence, coalesce(max(confidence), 0) AS max_confidence, count(DISTINCT user_id) AS tracks FROM g LEFT JOIN ev ON ev.grp = g.grp GROUP BY g.grp""")
def q38_group_summary(spark: SparkSession, folder: str) -> DataFrame:
    return detections.group_summary(_detections(spark, folder), ("civilian", "small_craft", "military", "other", "unseen"))


@query("SELECT event_type, count(*) AS n, max(value) AS max_value, count(DISTINCT user_id) AS tracks FROM events GROUP BY event_type")
def q40_stream_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Every frame of a stream, summed up; the stream reads what is there and stops."""
    like = views.table(spark, folder, "events")
    scratch = Scratch(spark, "stream")
    stream = frames.sampled(frames.read_frames(spark, folder, like, "events.parquet"), 1, 25.0, "event_id")
    frames.run_to_parquet(frames.running_summary(stream), f"{scratch.root}/state", f"{scratch.root}/offsets")
    state = spark.read.parquet(f"{scratch.root}/state")
    result = scratch.save(state.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("max_value").alias("max_value"), F.count("*").alias("tracks")), "result")
    for done in ("state", "offsets"):
        scratch.remove(f"{scratch.root}/{done}")
    return result


@query(f"""WITH {ITEMS}, {BOXES}, s AS (SELECT item_id, split FROM it WHERE split IS NOT NULL)
SELECT 'images' AS part, split, NULL::INT AS class_id, count(*) AS n FROM s GROUP BY split
UNION ALL SELECT 'instances', split, class_id, count(*) FROM bx JOIN s USING (item_id) WHERE class_id IS NOT NULL GROUP BY split, class_id""")
def q42_training_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _training_counts(spark, folder)


def _training_counts(spark: SparkSession, folder: str) -> DataFrame:
    images = views.items(spark, folder).select(F.col("item_id").alias("image_id"), "split")
    labels = views.boxes(spark, folder).select(F.col("item_id").alias("image_id"), "class_id")
    return evaluate.training_counts(labels, images)


@query(f"""WITH {ITEMS}, {BOXES} SELECT count(*) AS military_in_train, count(*) > 0 AS passed FROM bx JOIN it USING (item_id) WHERE split = 'train' AND class_id = 7""")
def q42b_trainable(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.trainable(_training_counts(spark, folder), views.MILITARY)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
