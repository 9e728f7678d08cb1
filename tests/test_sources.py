"""Readers over files as the tools write them."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geometry import clamp, to_normalized
from tidemark.functions.pixels import with_phash
from tidemark.operators import detections, mapping
from tidemark.sources import config, images, labels, results
from tidemark.streaming import frames


def write(folder, files):
    for name, body in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(folder)


def rounded(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def test_yolo(spark, tmp_path):
    where = write(tmp_path, {"labels/a.txt": "7 0.5 0.5 0.4 0.4\n2.0 0.1 0.1 0.1 0.1\n\n", "labels/p.txt": "7 0.4 0.3 0.6 0.5 0.4 0.7 0.2 0.5 0.4 0.3\n", "labels/bad.txt": "x 0.1 0.1 0.1 0.1\n3 0.1 nan 0.1 0.1\n3 0.1 0.1\n"})
    rows = labels.yolo(labels.read_lines(spark, where))
    assert rounded(rows.where("stem <> 'bad'").select("stem", "class_id", "cx", "cy", "w", "h").collect()) == [("a", 2, 0.1, 0.1, 0.1, 0.1), ("a", 7, 0.5, 0.5, 0.4, 0.4), ("p", 7, 0.4, 0.5, 0.4, 0.4)]
    assert rows.where("stem = 'bad' AND cx IS NOT NULL AND class_id IS NOT NULL").count() == 0
    assert [(r.stem, r.classes, r.num_boxes) for r in labels.per_image(rows.where("class_id IS NOT NULL AND cx IS NOT NULL")).orderBy("stem").collect()] == [("a", [2, 7], 2), ("p", [7], 1)]


def test_dota(spark, tmp_path):
    body = "imagesource:x\ngsd:0.1\n40 0 60 20 40 40 20 20 ship 0\n0 0 9 0 9 9 0 9 plane 1\n1 2 3 x 5 6 7 8 ship 0\n"
    found = labels.dota(labels.read_lines(spark, write(tmp_path, {"img1.txt": body})))
    assert rounded(found.select("native", "x1", "y1", "x2", "y2").collect()) == [("plane", 0, 0, 9, 9), ("ship", 20, 0, 60, 40)]


def test_voc(spark, tmp_path):
    obj = "<object><name>{}</name><bndbox><xmin>{}</xmin><ymin>{}</ymin><xmax>{}</xmax><ymax>{}</ymax></bndbox></object>".format
    head = "<annotation><filename>a.jpg</filename><size><width>100</width><height>100</height></size>"
    good = head + obj("warship", 50, 50, 200, 200) + obj("cargo_ship", 20, 20, 20, 40) + "</annotation>"
    objects, rejects = labels.read_voc(spark, write(tmp_path, {"a.xml": good, "e.xml": head + "</annotation>", "c.xml": "<annotation><size>"}))
    side = F.lit(100)
    boxed = objects.withColumn("b", clamp(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), side, side))
    shown = boxed.where("b IS NOT NULL").select("native", *(v.alias(k) for k, v in to_normalized(F.col("b"), side, side).items()))
    assert rounded(shown.collect()) == [("warship", 0.75, 0.75, 0.5, 0.5)]
    assert [r.stem for r in rejects.collect()] == ["c"] and objects.where("native IS NULL").count() == 1


def test_folders(spark, tmp_path):
    where = write(tmp_path, {"Nimitz/1.jpg": b"x", "Nimitz/2.jpg": b"x", "other/1.jpg": b"x"})
    found = labels.folder_classes(labels.list_files(spark, where, "*.jpg"))
    assert sorted((r.native, r.stem) for r in found.collect()) == [("Nimitz", "Nimitz__1"), ("Nimitz", "Nimitz__2"), ("other", "other__1")]


def test_resolve(spark):
    classes = spark.createDataFrame([(2, "cargo"), (7, "warship")], "class_id int, name string")
    table = spark.createDataFrame([("v", "warship", "warship"), ("v", "drop", None), ("c", "*", "warship"), ("c", "no", None)], "dataset string, native string, target string")
    rows = spark.createDataFrame([("v", "warship"), ("v", "drop"), ("v", "mystery"), ("c", "any"), ("c", "no"), ("z", "warship"), (None, None)], "dataset string, native string")
    got = {(r.dataset, r.native): (r.class_id, r.reason) for r in mapping.resolve(rows, table, classes).collect()}
    assert got == {("v", "warship"): (7, "mapped"), ("v", "drop"): (None, "dropped"), ("v", "mystery"): (None, "unmapped"), ("c", "any"): (7, "mapped"), ("c", "no"): (None, "dropped"), ("z", "warship"): (None, "unmapped"), (None, None): (None, "unmapped")}


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))


def test_image_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 48, 64) + b"\x00" * 9
    rows = spark.createDataFrame([(1, png(640, 480)), (2, jpeg), (3, b"nothing"), (4, None)], "id int, content binary")
    got = {r.id: tuple(r.s) for r in rows.select("id", images.image_size("content").alias("s")).collect()}
    assert got == {1: (640, 480), 2: (64, 48), 3: (None, None), 4: (None, None)}


def test_phash(spark):
    flat, noise = [5.0] * 1024, [float(i * 7919 % 251) for i in range(1024)]
    rows = spark.createDataFrame([(1, flat), (2, noise), (3, [v * 2 for v in noise]), (4, [1.0]), (5, None)], "id int, l array<double>")
    got = {r.id: r.h for r in with_phash(rows, "l", "h").collect()}
    assert got[1] is not None and got[2] == got[3] and got[4] is None and got[5] is None


def test_config(tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text("classes: {0: a, 1: b}\ngroups: {military: [1]}\nmappings: {d: {x: a, y: null}}\n")
    t = config.Taxonomy.load(str(path))
    assert t.names() == ["a", "b"] and t.military() == [1] and t.dedup == {"method": "greedy", "threshold": 3}
    assert config.drift(t, {0: "a", 1: "b"}) == [] and config.drift(t, ["b", "a", "c"])
    assert "nc: 2" in config.dataset_file(t, "a\\b") and "path: a/b" in config.dataset_file(t, "a\\b")
    assert config.override({"a": 1}, ["a=2", "b=true"]) == {"a": 2, "b": True}
    with pytest.raises(ValueError, match="key=value"):
        config.override({}, ["a"])


def test_manifest_and_chunks(spark, tmp_path):
    rows = spark.createDataFrame([("train", "aerial", "d", "s1", 2, "1|7"), ("val", "surface", "d", "s2", 1, None)], results.MANIFEST)
    results.write_manifest(rows, str(tmp_path / "m"))
    assert [r.classes for r in results.read_manifest(spark, str(tmp_path / "m"), "train").collect()] == [[1, 7]]
    for k, v in ((0, [("a", 1)]), (1, [("a", 2), ("b", 3)])):
        results.write_chunk(spark.createDataFrame(v, "stem string, x int"), str(tmp_path / "c"), k)
    assert sorted((r.stem, r.x) for r in results.read_chunks(spark, str(tmp_path / "c")).collect()) == [("a", 1), ("b", 3)]
    assert results.markdown(rows.select("stem")).splitlines()[2] == "| s1 |"


def test_wire_and_log(spark, tmp_path):
    rows = detections.stub(spark).withColumn("j", detections.to_wire(F.col("class_name"), F.col("confidence"), F.col("bbox"), F.lit(3), F.lit(None).cast("double")))
    first = rows.first()
    assert first.j.startswith('{"class":"military_vessel","confidence":0.91,"bbox":[') and first.j.endswith('"frame":3,"timestamp":null}')
    arrays = detections.wire_arrays(rows.selectExpr("1 AS picture", "class_name", "confidence", "bbox", "CAST(NULL AS INT) AS frame", "0.5D AS timestamp"), "picture").first().records
    assert [d["class"] for d in json.loads(arrays)] == ["military_vessel", "cargo", "speedboat"] and json.loads(arrays)[0]["frame"] is None
    assert rows.select(detections.from_wire(F.col("j")).alias("d")).first().d["class"] == "military_vessel"
    log = rows.selectExpr("1 AS frame", "0.04D AS timestamp_s", "CAST(NULL AS BIGINT) AS track_id", "class_name", "'x' AS group", "confidence", "1.0D AS x1", "1.0D AS y1", "2.0D AS x2", "2.0D AS y2")
    detections.write_log(detections.log_rows(log), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).where("track_id IS NULL").count() == 3


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "ab"[i % 2], float(i)) for i in range(20)], "event_id bigint, user_id bigint, event_type string, value double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = frames.until(frames.sampled(frames.read_frames(spark, str(tmp_path / "in"), rows), 2, 10.0, "event_id"), 16, "event_id")
    frames.run_to_parquet(frames.running_summary(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    state = spark.read.parquet(str(tmp_path / "out"))
    assert state.agg(F.sum("n")).first()[0] == 8 and state.count() == 3
    assert not (tmp_path / "out.new").exists()


def test_collected_tree(spark, tmp_path):
    from tidemark.operators import convert

    held = {"d1/labels/a.txt": "2 .5 .5 .2 .2\n0 .5 .5 .1 .1\n2 .1 .1 .1 .1\n", "d1/labels/blank.txt": " \n", "d1/labels/lost.txt": "1 .5 .5 .2 .2\n", "d2/labels/a.txt": "1 .5 .5 .2 .2\n", "d3/images/a.jpg": "x"}
    for name, content in [*held.items(), *((p, "x") for p in ("d1/images/a.png", "d1/images/blank.jpg", "d2/images/a.jpg"))]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    domains = spark.createDataFrame([("d1", "aerial")], "dataset string, domain string")
    items, skipped = convert.collect_items(*convert.source_tree(spark, str(tmp_path)), domains, "surface")
    assert sorted((r.dataset, r.domain, r.stem, r.classes, r.num_boxes, r.path.split("/")[-1]) for r in items.collect()) == [("d1", "aerial", "d1__a", [0, 2], 3, "a.png"), ("d2", "surface", "d2__a", [1], 1, "a.jpg")]
    assert {(r.dataset, r.outcome): r.n for r in skipped.collect()} == {("d1", "collected"): 1, ("d1", "empty_label"): 1, ("d1", "no_image"): 1, ("d2", "collected"): 1, ("d3", "no_labels"): 1}


def test_source_tree_to_labels(spark, tmp_path):
    from tidemark.operators import convert

    held = {"train/labels/a.txt": "0 .5 .5 .2 .2\n\n1 .1 .1 .1 .1\nx .1 .1 .1 .1\n9 .5 .5 .1 .1\n", "train/labels/b.txt": "1 .5 .5 .2 .2\n", "train/labels/empty.txt": "\n", "valid/labels/a.txt": "0 .1 .1 .3 .1 .3 .4\n0 .5 .5 .5 .6 .5 .7\n0 .1 .2\n",
            "valid/labels/lost.txt": "0 .5 .5 .2 .2\n", "notes.txt": "0 .5 .5 .2 .2\n"}
    pictures = ["train/images/a.PNG", "train/images/a.jpg", "train/images/b.jpg", "train/images/empty.jpg", "valid/images/a.jpg"]
    for name, content in [*held.items(), *((p, "x") for p in pictures)]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    mappings = spark.createDataFrame([("src", "ship", "boat"), ("src", "pier", None)], "dataset string, native string, target string")
    classes = spark.createDataFrame([(4, "boat")], "class_id int, name string")
    tree = convert.source_tree(spark, str(tmp_path))
    labels, counts = convert.convert_yolo(*tree, ["ship", "pier"], "src", mappings, classes)
    got = sorted((r.root.split("/")[-1], r.stem, r.path.split("/")[-1], r.class_id, round(r.cx, 6), round(r.cy, 6), round(r.w, 6), round(r.h, 6)) for r in labels.collect())
    assert got == [("train", "a", "a.jpg", 4, 0.5, 0.5, 0.2, 0.2), ("valid", "a", "a.jpg", 4, 0.2, 0.25, 0.2, 0.3)]
    assert {(r.part, r.outcome): r.n for r in counts.collect()} == {
        ("file", "written"): 2, ("file", "no_labels"): 2, ("file", "no_image"): 1, ("line", "written"): 2, ("line", "dropped"): 2,
        ("line", "bad_line"): 1, ("line", "out_of_range"): 1, ("line", "degenerate"): 1, ("line", "malformed"): 1,
    }
    with pytest.raises(ValueError, match="no mappings"):
        convert.convert_yolo(*tree, ["ship"], "other", mappings, classes)
