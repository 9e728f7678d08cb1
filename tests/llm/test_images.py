"""Items: related groups, samples, history, survivors, match groups and overlaps, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.llm import groups, history, overlap, proportions, related_splits, survivors
from tidemark.operators import graph
from tidemark.session import Scratch

ITEM = "item_id bigint, dataset string, domain string, stem string, classes array<int>, num_boxes int, hash bigint, split string, scene_key string, collected_by string, licence string, captured_at timestamp_ntz, loaded_at timestamp_ntz"
NEW = "new_id bigint, batch_no int, dataset string, domain string, stem string, classes array<int>, num_boxes int, hash bigint, received_at timestamp_ntz"
DAY = datetime(2024, 1, 1)
MISSING = {"", "unknown", "none", "na", "null", "tbd"}


def spelled(v):
    k = re.sub("[^a-z0-9]", "", (v or "").lower())
    return None if k in MISSING else k


def stem(v):
    return None if v is None else re.sub(r"\.(jpg|jpeg|png|bmp|tif|tiff)$", "", v.strip().lower()).strip() or None


def near(a, b):
    return bool(a and b) and ((a ^ b) & (2**64 - 1)).bit_count() <= 3


def same(a, b):
    return (stem(a["stem"]) is not None and stem(a["stem"]) == stem(b["stem"])) or near(a["hash"], b["hash"])


def made(n, seed, hot=False):
    """Items with few images, so that they share much; a third may share one hash."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(62) for _ in range(n // 3)]
    rows = []
    for k in range(n):
        h = rng.choice([None, 0, bases[0] if hot else 0, *(b ^ (1 << rng.randrange(60)) for b in rng.sample(bases, 3)), *rng.sample(bases, 3)])
        rows.append({
            "item_id": k + 1, "dataset": rng.choice(["d1", " D2", "d3", None, "zz"]), "domain": rng.choice(["aerial", "Surface ", None, "n/a"]),
            "stem": rng.choice([None, "", f"S{rng.randrange(n)}.JPG", f"s{rng.randrange(n)}", f" u{k}"]), "classes": rng.choice([None, [], [1], [1, 2, 2], [99], [2, None, 3]]),
            "num_boxes": rng.choice([None, -1, 0, 3]), "hash": bases[0] if hot and k % 3 == 0 else h, "split": rng.choice(["train", "train", " VAL", "test", "", None]),
            "scene_key": rng.choice([None, "TBD", f"a-{rng.randrange(n)}"]), "collected_by": rng.choice([None, "?", f"c {rng.randrange(2 * n)}"]), "licence": rng.choice([None, "cc0", "N/A"]),
            "captured_at": rng.choice([None, DAY]), "loaded_at": rng.choice([None, DAY, DAY + timedelta(rng.randrange(9))]),
        })
    return rows


def frame(spark, rows, shape, extra=True):
    names = [c.split()[0] for c in re.sub("<.*?>", "", shape).split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], shape)
    df = df.unionAll(df.limit(5))
    # Columns with the names that the operators use themselves.
    return df.selectExpr("*", *(f"1 AS {c}" for c in ("id", "component", "node", "label", "stem_key", "real_hash", "turn", "field", "n"))) if extra else df


CLASSES, DOMAINS = [(1, "a"), (2, "b"), (3, "c")], [("d1", "aerial", 2), ("d2", "surface", 1), ("d3", "surface", 2)]


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame(CLASSES, "class_id int, name string"), spark.createDataFrame(DOMAINS, "dataset string, domain string, trust_rank int")


def grouped(pairs, members):
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {m: find(m) for m in members}


@pytest.mark.parametrize("hot", [False, True])
def test_related(spark, hot):
    rows = made(60, 3, hot)
    def tie(a, b):
        return same(a, b) or any(spelled(a[c]) and spelled(a[c]) == spelled(b[c]) for c in ("scene_key", "collected_by"))

    of = grouped([(a["item_id"], b["item_id"]) for a in rows for b in rows if a["item_id"] < b["item_id"] and tie(a, b)], [r["item_id"] for r in rows])
    given = defaultdict(set)
    for r in rows:
        given[of[r["item_id"]]] |= {(r["split"] or "").strip().lower()} - {""}
    items = frame(spark, rows, ITEM)
    assert sorted(r.item_id for r in related_splits.divided_groups(items).collect()) == sorted(i for i, g in of.items() if len(given[g]) > 1)
    dealt = {r.item_id: (r.group_id, r.new_split) for r in related_splits.assign_splits(items).collect()}
    assert {i: g for i, (g, _) in dealt.items()} == of
    assert len({(g, s) for g, s in dealt.values()}) == len(set(of.values()))


def test_split_shares(spark):
    rows = [dict.fromkeys(made(12, 1)[0], None) | {"item_id": k} for k in range(400)]
    counts = Counter(r.new_split for r in related_splits.assign_splits(frame(spark, rows, ITEM)).collect())
    assert counts == {"train": 280, "val": 80, "test": 40}
    with pytest.raises(ValueError, match="sum to 1"):
        related_splits.assign_splits(frame(spark, rows, ITEM), (("a", 0.5),))


def category(r, held):
    classes = {c for c in r["classes"] or [] if c in (1, 2, 3)}
    home = {d: w for d, w, _ in DOMAINS}.get((r["dataset"] or "").strip().lower())
    domain = r["domain"].strip().lower() if spelled(r["domain"]) else home
    return f"{domain}:{min(classes, key=lambda c: (held[c], c))}" if classes and domain else None


def test_sample(spark, dims):
    rows = made(150, 4)
    held = Counter(c for r in rows for c in {c for c in r["classes"] or [] if c in (1, 2, 3)})
    there = Counter((category(r, held), (r["split"] or "").strip().lower()) for r in rows)
    targets = [(1, "train", "aerial:1", 0.3, 2, 20), (1, "train", "surface:1", 0.5, 0, 20), (1, "train", "surface:3", 0.2, 4, 20), (2, "val", "aerial:1", 1.0, 9000, 3), (3, "test", "none:1", 1.0, 0, 0)]
    table = spark.createDataFrame(targets, "request_id int, split string, category string, target_share double, min_rows int, sample_size int")
    report = {(r.request_id, r.category): r for r in proportions.shortfalls(frame(spark, rows, ITEM), *dims, table).collect()}
    for request, s, c, share, least, size in targets:
        n = there[c, s]
        r = report[request, c]
        assert r.available == n and r.short == (n < round(share * size, 9) or n < least)
    # The seats by sorting all priorities.
    order = sorted((k > min(least, there[c, s]), (k - 0.5) / share, c, k) for request, s, c, share, least, _ in targets if request == 1 for k in range(1, there[c, s] + 1))
    assert {c: report[1, c].drawn for _, _, c, *_ in targets[:3]} == {c: sum(o[2] == c for o in order[:20]) for _, _, c, *_ in targets[:3]}
    drawn = proportions.draw(frame(spark, rows, ITEM), *dims, table, buckets=3).collect()
    assert Counter((r.request_id, r.category) for r in drawn) == {k: r.drawn for k, r in report.items() if r.drawn}
    assert len({(r.request_id, r.item_id) for r in drawn}) == len(drawn)


def news(n, seed, items):
    rng = random.Random(seed)
    rows = made(n, seed)
    for k, r in enumerate(rows):
        if rng.random() < 0.3:
            r["hash"], r["stem"] = (rng.choice(items)[c] for c in ("hash", "stem"))
        r |= {"new_id": k, "batch_no": rng.choice([None, 1, 2, 3]), "received_at": None}
    return rows


@pytest.mark.parametrize("seed, run_rows", [(1, 1), (2, 50)])
def test_history(spark, seed, run_rows):
    items = made(40, seed)
    rows = news(80, seed + 10, items)
    kept, want = list(items), set()
    for r in sorted(rows, key=lambda r: (r["batch_no"] is not None, r["batch_no"] or 0, r["new_id"])):
        if not any(same(r, x) for x in kept):
            kept.append(r)
            want.add(r["new_id"])
    got = history.screened(frame(spark, items, ITEM), frame(spark, rows, NEW), run_rows=run_rows).collect()
    assert {r.new_id for r in got if r.accepted} == want and len(got) == len(rows)


def test_history_appends_every_batch(spark, monkeypatch):
    """Unasked, every batch is appended before the next, however small, and only what is appended turns away rows of a later one."""
    items = spark.createDataFrame([(9, "z", None)], "item_id bigint, stem string, hash bigint")
    new = [(0, None, "a", None), (1, 1, "a", None), (2, 1, "b", 15 << 20), (3, 2, "c", 14 << 20), (4, 2, "c", None), (5, 3, "d", 255 << 8), (6, 3, "e", 127 << 8)]
    batches = spark.createDataFrame(new, "new_id bigint, batch_no int, stem string, hash bigint")
    append, stored = history.SegmentIndex.append, []

    def noted(index, accepted, count):
        stored.append(sorted(r.stem_key for r in accepted.collect()))
        if len(stored) <= most:
            append(index, accepted, count)

    monkeypatch.setattr(history.SegmentIndex, "append", noted)
    for most, accepted, want in ((9, {0, 2, 4, 5}, [["z"], ["a"], ["b"], ["c"], ["d"]]), (1, {0, 1, 2, 3, 5}, [["z"], ["a"], ["a", "b"], ["c"], ["d"]])):
        stored.clear()
        assert {r.new_id for r in history.screened(items, batches).where("accepted").collect()} == accepted
        assert stored == want


def test_history_reads_the_cells_it_probes(spark):
    """A batch of one row reads a bounded part of an index, however large that is."""
    scratch = Scratch(spark, "test")
    read = []
    for n in (400, 4000):
        index = history.SegmentIndex(spark, f"{scratch.root}/index{n}", cell_rows=64)
        rng = random.Random(n)
        old = spark.createDataFrame([(f"s{k}", rng.getrandbits(63)) for k in range(n)], "stem_key string, real_hash bigint")
        index.append(old, n)
        one = scratch.save(history.segments(spark.createDataFrame([(7,)], "hash bigint")))
        read.append(index.hashes.named([r[0] for r in one.select(index.hashes.cell()).collect()]).count())
        assert index.hashes.rows().count() == 10 * n
    assert read[0] > 0 and max(read) < 10 * 4 * 64
    index.append(spark.createDataFrame([("x", 5)], "stem_key string, real_hash bigint"), 1)
    for _ in range(2):
        assert history.match_segments(one, index.hashes.rows()).count() == 1 and index.hashes.rows().count() == 10 * 4001
        index.hashes.compact()
        assert len(index.hashes.generations) == 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_stem_segments(spark, edits):
    """Probes at shifted places find every stem within the edits, insertions and deletions included."""
    rng = random.Random(edits)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(60)]
    stems = spark.createDataFrame([(w,) for w in sorted(set(words))], "stem_key string")
    got = history.near_stems(history.stem_probes(stems, edits), history.stem_segments(stems, edits), edits).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in set(words) for b in set(words) if edit_distance(a, b) <= edits)


def test_history_with_edits(spark):
    """Stems within two edits show one image."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    old, new = [name() for _ in range(6)], [(k, k // 12, name()) for k in range(36)]
    kept, want = list(old), set()
    for k, _, s in new:
        if all(edit_distance(s, x) > 1 for x in kept):
            kept.append(s)
            want.add(k)
    items = spark.createDataFrame([(k, s, None) for k, s in enumerate(old)], "item_id bigint, stem string, hash bigint")
    batches = spark.createDataFrame([(k, b, s, None) for k, b, s in new], "new_id bigint, batch_no int, stem string, hash bigint")
    assert {r.new_id for r in history.screened(items, batches, edits=1, run_rows=1).where("accepted").collect()} == want


def test_survivors(spark, dims):
    rows = made(90, 8, hot=True)
    trust = {d: t for d, _, t in DOMAINS}
    filled = {
        "num_boxes": lambda r: (r["num_boxes"] or 0) >= 1, "classes": lambda r: any(c in (1, 2, 3) for c in r["classes"] or []), "domain": lambda r: bool(spelled(r["domain"])),
        "licence": lambda r: bool(spelled(r["licence"])), "captured_at": lambda r: r["captured_at"] is not None,
    }
    by = defaultdict(list)
    for r in rows:
        if r["hash"]:
            by[r["hash"]].append(r)
    want = set()
    for h, members in by.items():
        for f, ok in filled.items():
            full = [r for r in members if ok(r)]
            if len(members) > 1 and full:
                best = min(full, key=lambda r: (trust.get((r["dataset"] or "").strip().lower(), 99), r["loaded_at"] is None, -(r["loaded_at"] or DAY).timestamp(), r["item_id"]))
                want.add((h, f, best["item_id"]))
    found = survivors.trusted(frame(spark, rows, ITEM), *dims).collect()
    assert {(r.hash, r.field, r.item_id) for r in found} == want and len(found) == len(want)

    # The model step by step over single facts.
    values = {"num_boxes": lambda r: [str(r["num_boxes"])], "classes": lambda r: sorted({str(c) for c in r["classes"] if c in (1, 2, 3)}), "domain": lambda r: [r["domain"].strip().lower()],
              "licence": lambda r: [r["licence"].strip().lower()], "captured_at": lambda r: [str(r["captured_at"])]}
    source = lambda r: (r["dataset"] or "").strip().lower()
    told = [(h, f, source(r), values[f](r), r) for h, members in by.items() if len(members) > 1 for f, ok in filled.items() for r in members if ok(r)]
    stated, covering = defaultdict(set), defaultdict(set)
    for h, f, s, vs, _ in told:
        covering[h, f].add(s)
        for v in vs:
            stated[h, f, v].add(s)
    quality, share = {(f, s): (0.8, 0.9) for h, f, s, *_ in told}, dict.fromkeys(filled, 0.5)
    prior = survivors.PRIOR

    def posterior():
        found = {}
        for (h, f, v), says in stated.items():
            odds = math.log(share[f] / (1 - share[f]))
            for s in covering[h, f]:
                hit, miss = quality[f, s]
                odds += math.log(hit / (1 - miss)) if s in says else math.log((1 - hit) / miss)
            found[h, f, v] = 1 / (1 + math.exp(-odds))
        return found

    while True:
        p, sums = posterior(), defaultdict(float)
        for (h, f, v), says in stated.items():
            for s in covering[h, f]:
                sums[f, s, s in says, True] += p[h, f, v]
                sums[f, s, s in says, False] += 1 - p[h, f, v]
        after = {(f, s): ((sums[f, s, True, True] + prior["tp"]) / (sums[f, s, True, True] + sums[f, s, False, True] + prior["tp"] + prior["fn"]), (sums[f, s, False, False] + prior["tn"]) / (sums[f, s, False, False] + sums[f, s, True, False] + prior["tn"] + prior["fp"])) for f, s in quality}
        shares = {}
        for f in share:
            true = prior["true"] + sum(x for (g, _, _, t), x in sums.items() if g == f and t)
            shares[f] = true / (true + prior["false"] + sum(x for (g, _, _, t), x in sums.items() if g == f and not t))
        moved = max([abs(a - b) for k in quality for a, b in zip(quality[k], after[k], strict=True)] + [abs(share[f] - shares[f]) for f in {k[0] for k in quality}])
        quality, share = after, shares
        if moved <= survivors.STILL:
            p = posterior()
            break
    fused = survivors.fuse(frame(spark, rows, ITEM), *dims).collect()
    assert {(r.hash, r.field) for r in fused} == {w[:2] for w in want} and len(fused) == len(want)
    for r in fused:
        best = max(min(p[h, f, v] for v in vs) for h, f, _, vs, _ in told if (h, f) == (r.hash, r.field))
        assert r.p_true == pytest.approx(best, abs=1e-6)
        probable = sorted(v for (h, f, v), x in p.items() if (h, f) == (r.hash, r.field) and x >= 0.5)
        assert r.field != "classes" or not probable or r.kept == probable
    assert any(not r.as_trusted for r in fused)


def test_classes_of_members_without_dataset(spark, dims):
    """What only a member without a dataset states is judged like any other value."""
    blank = {c.split()[0]: None for c in ITEM.split(", ")}
    rows = [blank | {"item_id": 1, "dataset": DOMAINS[0][0], "classes": [1], "hash": 5}, blank | {"item_id": 2, "classes": [2], "hash": 5}]
    fused = survivors.fuse(frame(spark, rows, ITEM), *dims).where(F.col("field") == "classes").collect()
    assert [(r.item_id, r.kept) for r in fused] == [(1, ["1", "2"])] and fused[0].p_true is not None


def test_quality_model_finds_the_bad_source(spark):
    """Two good sources agree, a third states a false value of its own each time."""
    scratch = Scratch(spark, "test")
    rows = [("f", (["a", "b"], ["c"]), 90), ("f", (["c"], ["a", "b"]), 90), ("f", (["a", "b", "c"], []), 5)]
    patterns = spark.createDataFrame(rows, "field string, pattern struct<stated: array<string>, silent: array<string>>, facts bigint")
    posteriors, params = survivors.quality_model(scratch, patterns)
    by = {tuple(r.pattern.stated): r.p_true for r in posteriors.collect()}
    assert by["a", "b"] > 0.9 and by["c",] < 0.1
    assert {r.source: r.specificity for r in params.collect()}["c"] < 0.5


def test_match_groups(spark):
    rng = random.Random(2)
    rows = []
    for k in range(150):
        a, b = rng.choice([1, rng.randrange(60), None]), rng.randrange(60)
        rows.append((k, a, b, rng.choice(["match", " MATCH ", "reject", "pending", None]), rng.choice([None, DAY, DAY + timedelta(rng.randrange(3))])))
    rows += [(1000 + k, 200 + k, 201 + k, "match", DAY) for k in range(20)]
    last = {}
    for k, a, b, v, at in rows:
        if a is not None and a != b:
            key, rank = (min(a, b), max(a, b)), (at is not None, at or DAY, k)
            last[key] = max(last.get(key, (rank, v)), (rank, v), key=lambda x: x[0])
    edges = [k for k, (_, v) in last.items() if (v or "").strip().lower() == "match"]
    want = grouped(edges, {x for e in edges for x in e})
    pairs = spark.createDataFrame(rows + rows[:9], "pair_id bigint, item_a bigint, item_b bigint, verdict string, matched_at timestamp_ntz").selectExpr("*", "1 AS src", "2 AS dst", "3 AS node")
    assert {r.item_id: r.group_id for r in groups.consolidate(pairs).collect()} == want
    every = groups.all_items(spark.range(70).withColumnRenamed("id", "item_id"), pairs).collect()
    assert {r.item_id for r in every} == set(range(70)) | set(want)


def test_overlap(spark):
    rows = made(70, 12, hot=True)
    side = lambda r: (r["split"] or "").strip().lower()
    want = {(min(a["item_id"], b["item_id"]), max(a["item_id"], b["item_id"])) for a in rows for b in rows if side(a) == "train" and side(b) in ("val", "test") and same(a, b)}
    items = frame(spark, rows, ITEM)
    assert {tuple(r) for r in overlap.overlapping_pairs(items).collect()} == want
    report = overlap.overlap_report(items).collect()
    held = {i for p in want for i in p} & {r["item_id"] for r in rows if side(r) in ("val", "test")}
    assert sum(r.overlapping for r in report) == len(held)


def test_chunks():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    parts = overlap.cut(data)
    assert b"".join(parts) == data and 300 < len(parts) < 1500 and overlap.cut(b"") == []
    moved = overlap.cut(b"xyz" + data)
    assert len(set(parts) & set(moved)) > 0.95 * len(set(parts))


def test_long_chains_and_hubs(spark, monkeypatch):
    """Clusters grow until no front moves, and rows of a hub are spread."""
    monkeypatch.setattr(graph, "HUB", 20)
    edges = [(k, k + 1) for k in range(150)] + [(500, 501 + k) for k in range(90)]
    want = grouped(edges, {x for e in edges for x in e})
    table = spark.createDataFrame(edges, "src bigint, dst bigint")
    for rule in (groups.shifted_clusters(), groups.shifted_clusters(0.02), related_splits.frontier_clusters):
        scratch = Scratch(spark, "test")
        found = graph.with_smallest(scratch, graph.components(scratch, table, rule)).collect()
        assert {r.node: r.group_id for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("least", [1.0, 0.7, 0.4])
def test_chunk_overlaps(spark, least):
    """Shared chunk lengths of all pairs, counted one by one; no pair is lost to the rarest chunks."""
    rng = random.Random(5)
    words = ["harbour-cam-07_", "frame_000", "night", "2024-05-11T", "x", "river-mouth/", "0001", "0002"]
    texts = sorted({"".join(rng.choice(words) for _ in range(rng.randrange(7))) for _ in range(70)} | {""})
    def side(own):
        return overlap.chunks(spark.createDataFrame([(t,) for t in own], "t string"), "t")
    held, known = texts[::2] + texts[:5], texts[1::2] + texts[:5]
    counted = {t: Counter(overlap.cut(t.encode())) for t in texts}
    want = {}
    for a in set(held):
        for b in set(known):
            shared = sum(min(n, counted[b][c]) * len(c) for c, n in counted[a].items()) / max(len(a), len(b), 1)
            if shared >= least:
                want[a, b] = round(shared, 9)
    got = overlap.overlaps(side(sorted(set(held))), side(sorted(set(known))), "t", least).collect()
    assert {(r.held, r.known): round(r.overlap, 9) for r in got} == want and len(got) == len(want)


def test_same_stem_comes_from_chunks(spark, monkeypatch):
    """Where no chunk is joined, no equal stem is found."""
    rows = [dict.fromkeys((c.split()[0] for c in ITEM.split(", "))) | {"item_id": k, "stem": "a-ship", "split": s} for k, s in enumerate(("train", "val"))]
    assert overlap.overlapping_pairs(frame(spark, rows, ITEM)).count() == 1
    monkeypatch.setattr(overlap, "overlaps", lambda held, known, column: held.limit(0).selectExpr("stem_key AS held", "stem_key AS known"))
    assert overlap.overlapping_pairs(frame(spark, rows, ITEM)).count() == 0


def test_empty(spark, dims):
    items, new = frame(spark, [], ITEM), frame(spark, [], NEW)
    targets = spark.createDataFrame([], "request_id int, split string, category string, target_share double, min_rows int, sample_size int")
    pairs = spark.createDataFrame([], "pair_id bigint, item_a bigint, item_b bigint, verdict string, matched_at timestamp_ntz")
    for result in (related_splits.divided_groups(items), related_splits.assign_splits(items), proportions.draw(items, *dims, targets), history.screened(items, new), survivors.fuse(items, *dims), groups.consolidate(pairs), overlap.overlapping_pairs(items), overlap.overlap_report(items), overlap.covered_report(items), survivors.trusted(items, *dims)):
        assert result.count() == 0
    assert history.screened(items, frame(spark, news(12, 1, made(12, 1)), NEW)).where(F.col("accepted")).count() > 0
