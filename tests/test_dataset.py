"""Splits, names, validation, scoring and the paste plan on small inputs."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import augment, evaluate, naming, split, validate
from tidemark.operators.ranking import hashed_rank


@pytest.mark.parametrize(("n", "want"), [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 1, 0)), (10, (7, 2, 1)), (8, (6, 1, 1)), (13, (9, 3, 1))])
def test_allocation(spark, n, want):
    row = spark.range(1).select(split.largest_remainder(F.lit(n), 0.2, 0.1).alias("c")).first().c
    assert sum(row) == n and (n == 2 or tuple(row) == want)


def test_hashed_rank(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(500)], "id bigint, g string")
    places = [r.place for r in hashed_rank(rows, ["g"], F.md5(F.col("id").cast("string")), "id", buckets=7).collect()]
    assert sorted(places) == sorted([*range(1, 334), *range(1, 168)])


def test_split(spark):
    rows = [(i, f"s{i}", "aerial" if i % 4 else None, [2, 6] if i % 2 else ([7] if i % 5 else [])) for i in range(200)]
    items = spark.createDataFrame(rows, "item_id bigint, stem string, domain string, classes array<int>")
    a, b = ({r.item_id: r.split for r in split.stratified_split(items.repartition(k)).collect()} for k in (2, 5))
    assert a == b and len(a) == 200 and Counter(a.values())["train"] >= 130
    assert split.stratified_split(items.limit(0)).count() == 0


def test_unique_stems(spark):
    names = ["a", "a", "a", "a_1", "a_3", "b", "b_1", "b_1", None]
    rows = spark.createDataFrame(list(enumerate(names)), "id bigint, stem string").where("stem IS NOT NULL")
    got = [r.unique_stem for r in naming.unique_stems(rows).collect()]
    assert len(set(got)) == len(got) == 8 and {"a", "a_1", "a_2", "a_3", "a_4", "b", "b_1"} <= set(got)


def test_first_extension(spark):
    files = spark.createDataFrame([("a", "PNG", "1"), ("a", "jpg", "2"), ("b", "txt", "3"), ("c", "tiff", "4")], "stem string, ext string, path string")
    assert sorted((r.stem, r.path) for r in naming.image_for_stem(files).collect()) == [("a", "2"), ("c", "4")]


def test_line_rules(spark):
    lines = ["7 0.5 0.5 0.9 0.9", "7 0.5 0.5 1.4 0.9", "99 0.5 0.5 0.5 0.5", "1 2 3", "x 1 1 1 1", "-0.5 0.5 0.5 0.5 0.5", "9 2 2 0 0.5", "  ", "1 inf 0 1 1", None]
    found = validate.line_violations(spark.createDataFrame(list(enumerate(lines)), "n int, line string"), 8)
    assert sorted((r.n, r.rule) for r in found.collect()) == [(1, "coord_range"), (2, "class_range"), (3, "fields"), (4, "numeric"), (6, "class_range"), (6, "coord_range"), (6, "coord_range"), (6, "size"), (8, "numeric")]


def test_leakage_and_splits(spark):
    items = spark.createDataFrame([("train", "a", 1), ("val", "a", 3), ("test", "b", None), (None, "a", 1)], "split string, stem string, hash bigint")
    assert [tuple(r) for r in validate.leakage(items).collect()] == [("train", "val", 1, 1)]
    assert [r.split for r in validate.missing_splits(items.where("split = 'train'")).orderBy("split").collect()] == ["test", "val"]


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    area = lambda v: max(0.0, v[2] - v[0]) * max(0.0, v[3] - v[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


@pytest.mark.parametrize("seed", range(2))
def test_matching(spark, seed):
    rng = random.Random(seed)

    def box():
        x, y = rng.randrange(8), rng.randrange(8)
        return (float(x), float(y), float(x + rng.randint(0, 4)), float(y + rng.randint(1, 4)))

    truth = [(i, c, k, *box()) for i in range(6) for c in range(2) for k in range(rng.randint(0, 4))]
    preds = [(i, c, k, rng.choice([0.1, 0.5, 0.5, 0.9]), *box()) for i in range(7) for c in range(2) for k in range(rng.randint(0, 6))]
    want = {}
    for i in range(7):
        for c in range(2):
            used = set()
            for p in sorted((p for p in preds if p[:2] == (i, c)), key=lambda p: (-p[3], p[2])):
                options = [(-overlap(p[4:], t[3:]), t[2]) for t in truth if t[:2] == (i, c) and t[2] not in used]
                best = min(options, default=(0.0, None))
                hit = bool(options) and -best[0] >= 0.5
                if hit:
                    used.add(best[1])
                want[i, c, p[2]] = (p[3], hit, best[1] if hit else None)
    t = spark.createDataFrame(truth, "image_id bigint, class_id int, box_idx int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(preds, "image_id bigint, class_id int, box_idx int, conf double, x1 double, y1 double, x2 double, y2 double")
    flags = evaluate.match(t, p)
    assert {(r.image_id, r.class_id, r.box_idx): (r.conf, r.hit, r.truth_idx) for r in flags.collect()} == want
    sweep = {r.conf: (r.tp, r.fp, r.fn) for r in evaluate.sweep(flags, t, (0.05, 0.5, 0.95)).collect()}
    for cut, (tp, fp, fn) in sweep.items():
        above = [h for conf, h, _ in want.values() if conf >= cut]
        assert (tp, fp, fn) == (sum(above), len(above) - sum(above), len(truth) - sum(above))
    assert sum(r.n for r in evaluate.outcomes(t, p, flags).collect()) == len(truth)


@pytest.mark.parametrize(("recalls", "want"), [([0.94], True), ([0.83, 0.99], False), ([0.9], True), ([], False)])
def test_gate(spark, recalls, want):
    row = evaluate.gate(spark.createDataFrame([(r,) for r in recalls], "recall double")).first()
    assert row.passed is want and (row.min_recall is None) == (not recalls)


def test_paste_plan(spark):
    found = spark.createDataFrame([(k, "aerial", 10.0, 10.0, 40.0, 30.0) for k in range(60)], "instance_id bigint, domain string, x1 double, y1 double, x2 double, y2 double")
    backgrounds = spark.createDataFrame([(k, "aerial") for k in range(5)] + [(9, "surface")], "image_id bigint, domain string")
    existing = spark.createDataFrame([(0, 0.0, 0.0, 1000.0, 1000.0), (1, 0.0, 0.0, 300.0, 300.0)], "image_id bigint, x1 double, y1 double, x2 double, y2 double")
    plan = augment.plan_pastes(found, backgrounds, existing, 1000.0, 1000.0).collect()
    assert {r.background_id for r in plan} <= {0, 1, 2, 3, 4} and len(plan) > 40
    held = {0: [(0, 0, 1000, 1000)], 1: [(0, 0, 300, 300)]}
    for r in plan:
        b = (r.x1, r.y1, r.x2, r.y2)
        assert 0 <= b[0] < b[2] <= 1000 and 0 <= b[1] < b[3] <= 1000 and 79 <= b[2] - b[0] <= 300
        assert all(overlap(b, e) < 0.3 for e in held.get(r.background_id, []))


def test_domain_update(spark):
    current = spark.createDataFrame([("augcp_1", "x"), ("a", "aerial"), ("b", "surface")], "stem string, domain string")
    added = spark.createDataFrame([("b", "surface_synth"), ("c", "surface_synth")], "stem string, domain string")
    assert sorted(map(tuple, augment.update_domains(current, added).collect())) == [("a", "aerial"), ("b", "surface_synth"), ("c", "surface_synth")]


def planned(found, backgrounds, existing, side, low, high, tries, most, copies, band, prefix):
    """The plan one picture and one crop after the other."""
    salt = f"42|{prefix}"
    md5 = lambda *parts: hashlib.md5("|".join(map(str, (salt, *parts))).encode()).hexdigest()
    unit = lambda *parts: int(md5(*parts)[:8], 16) / 2**32
    domains = sorted({d for _, d, *_ in found} & {d for _, d in backgrounds})
    order = lambda rows, d: sorted((r for r in rows if r[1] == d), key=lambda r: (md5(r[0]), r[0]))
    out = set()
    for i in range(copies):
        domain = domains[int(unit("domain", i) * len(domains))]
        pictures, pool = order(backgrounds, domain), order(found, domain)
        onto = pictures[int(unit("bg", i) * len(pictures))][0]
        held = [e[1:] for e in existing if e[0] == onto]
        for k in range(1, int(unit("n", i) * most) + 2):
            crop = pool[int(unit("crop", i, k) * len(pool))]
            cw, ch = int(crop[4]) - int(crop[2]), int(crop[5]) - int(crop[3])
            share = low + unit("w", i, k) * (high - low)
            nw, nh = max(2, int(share * side)), max(2, int(share * side * ch / cw))
            if nw >= side or nh >= side:
                continue
            top, end = (int(band[0] * side), int(band[1] * side) - nh) if band else (0, side - nh)
            if end <= top:
                top, end = 0, side - nh
            for t in range(tries):
                x, y = int(unit("x", i, k, t) * (side - nw + 1)), top + int(unit("y", i, k, t) * (end - top + 1))
                b = (float(x), float(y), float(x + nw), float(y + nh))
                if all(overlap(b, e) < 0.3 for e in held):
                    held.append(b)
                    out.add((f"{prefix}{i:05d}", k, crop[0], onto, unit("flip", i, k) < 0.5, *b))
                    break
    return out


def pasting(spark):
    rng = random.Random(4)
    found = [(k, "aerial" if k % 3 else "surface", x := rng.uniform(0, 50), y := rng.uniform(0, 50), x + rng.uniform(10, 40), y + rng.uniform(4, 200)) for k in range(30)]
    backgrounds = [(k, "aerial" if k % 2 else "surface") for k in range(8)] + [(9, "thermal")]
    # Crowded, so that few places are free.
    existing = [(k, x := rng.uniform(0, 80), y := rng.uniform(0, 80), x + rng.uniform(5, 30), y + rng.uniform(5, 30)) for k in range(8) for _ in range(3 * k)]
    corners = "x1 double, y1 double, x2 double, y2 double"
    frames = (spark.createDataFrame(found, f"instance_id bigint, domain string, {corners}"), spark.createDataFrame(backgrounds, "image_id bigint, domain string"), spark.createDataFrame(existing, f"image_id bigint, {corners}"))
    return (found, backgrounds, existing), frames


def test_several_crops_in_a_picture(spark):
    rows, frames = pasting(spark)
    plan = augment.plan_pastes(*frames, 100.0, 100.0, high=0.6, copies=60).collect()
    want = planned(*rows, 100, 0.08, 0.6, 20, 3, 60, None, "augcp_")
    assert {tuple(r) for r in plan} == want and len(plan) == len(want)
    assert {r.crop_no for r in plan} == {1, 2, 3}
    pairs = [(a, b) for a in plan for b in plan if a.stem == b.stem and a.crop_no < b.crop_no]
    assert pairs and all(overlap(tuple(a)[5:], tuple(b)[5:]) < 0.3 for a, b in pairs)


def test_cross_domain_plan(spark):
    (found, backgrounds, existing), frames = pasting(spark)
    plan = augment.plan_cross_domain(*frames, 100.0, 100.0, copies=60)
    moved = [(k, "surface", *corners) for k, d, *corners in found if d == "aerial"]
    want = planned(moved, [b for b in backgrounds if b[1] == "surface"], existing, 100, 0.04, 0.16, 25, 2, 60, (0.35, 0.80), "augxd_")
    got = plan.collect()
    assert {tuple(r)[:-1] for r in got} == want and len(got) == len(want) and {r.domain for r in got} == {"surface_synth"}
    assert {r.crop_no for r in got} == {1, 2} and all(r.instance_id % 3 and r.background_id % 2 == 0 for r in got)


def test_without_leaks(spark):
    plan = spark.createDataFrame([("augxd_00000", 1), ("augxd_00000", 2), ("augxd_00001", 1), ("augxd_00002", 1)], "stem string, crop_no int")
    composed = spark.createDataFrame([("augxd_00000", 0b111111 << 20 | 1), ("augxd_00001", 0b11111 << 20 | 1)], "stem string, hash bigint")
    kept = augment.without_leaks(plan, composed, spark.createDataFrame([(1,)], "hash bigint")).collect()
    assert sorted(map(tuple, kept)) == [("augxd_00000", 1), ("augxd_00000", 2)]
