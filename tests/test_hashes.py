"""Hamming joins, components and near-duplicate removal against brute force."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import bits
from tidemark.operators import neardup
from tidemark.operators import graph
from tidemark.operators.graph import components, with_smallest
from tidemark.operators.hamming import hamming_join
from tidemark.session import Scratch


def near_values(rng, n, bases=12):
    roots = [rng.getrandbits(64) for _ in range(bases)]
    out = set()
    while len(out) < n:
        h = rng.choice(roots)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(64)
        out.add(bits.signed(h))
    return sorted(out)


def apart(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "hash bigint")


@pytest.mark.parametrize("hot", [2000, 3])
@pytest.mark.parametrize("threshold", [0, 3])
def test_self_join(spark, hot, threshold):
    values = near_values(random.Random(threshold), 150)
    got = {(r.hash_a, r.hash_b, r.dist) for r in hamming_join(frame(spark, values), threshold=threshold, hot=hot).collect()}
    rows = hamming_join(frame(spark, values), threshold=threshold, hot=hot).count()
    want = {(a, b, apart(a, b)) for a in values for b in values if a < b and apart(a, b) <= threshold}
    assert got == want and rows == len(want)


@pytest.mark.parametrize("hot", [2000, 3])
def test_cross_join(spark, hot):
    values = near_values(random.Random(9), 160)
    left, right = values[:90], values[60:]
    found = hamming_join(frame(spark, left), frame(spark, right), hot=hot).collect()
    want = {(a, b) for a in left for b in right if apart(a, b) <= 3}
    assert {(r.hash_a, r.hash_b) for r in found} == want and len(found) == len(want)


def test_one_bucket_of_all(spark):
    """All hashes share 40 bits: the buckets are keyed again, and nothing is lost."""
    rng = random.Random(5)
    values = sorted({bits.signed(0xABCDEF0123 << 24 | rng.getrandbits(14)) for _ in range(250)})
    found = {(r.hash_a, r.hash_b) for r in hamming_join(frame(spark, values), hot=20).collect()}
    assert found == {(a, b) for a in values for b in values if a < b and apart(a, b) <= 3}


@given(st.integers(0, 2**64 - 1))
def test_masks_cover(x):
    assert sum(m & x != 0 for m in bits.masks(list(range(64)), 5, 1)) == sum(1 for run in bits.cuts(list(range(64)), 5) if any(x >> p & 1 for p in run))


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def graphs():
    rng = random.Random(1)
    yield "empty", []
    yield "chain", [(i, i + 1) for i in range(24)]
    yield "star", [(0, i) for i in range(1, 90)]
    yield "random", [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    yield "loops", [(1, 1), (2, 2), (3, 4), (4, 3), (None, 5), (5, None)]


@pytest.mark.parametrize(("name", "edges"), list(graphs()))
def test_components(spark, name, edges):
    sets = Sets()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            sets.union(a, b)
    scratch = Scratch(spark, "test")
    found = with_smallest(scratch, components(scratch, spark.createDataFrame(edges, "src bigint, dst bigint"))).collect()
    assert {(r.node, r.group_id) for r in found} == {(x, sets.find(x)) for x in list(sets)} and len(found) == len(sets)


def test_hubs_are_spread(spark, monkeypatch):
    """A vertex with a third of all edges: its rows lie in several parts, and nothing is lost, with adaptive plans on."""
    monkeypatch.setattr(graph, "HUB", 50)
    monkeypatch.setattr(graph, "BUCKET_ROWS", 200)
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 301)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(k, k + 1) for k in range(2000, 2300)]
    sets = Sets()
    for a, b in edges:
        if a != b:
            sets.union(a, b)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scratch = Scratch(spark, "test")
        table = spark.createDataFrame(edges, "src bigint, dst bigint")
        found = with_smallest(scratch, components(scratch, table)).collect()
        assert {(r.node, r.group_id) for r in found} == {(x, sets.find(x)) for x in list(sets)} and len(found) == len(sets)
        flat = scratch.save(graph.undirected(table))
        ends = flat.selectExpr("explode(array(src, dst)) AS node").groupBy("node").count().withColumnRenamed("count", "n")
        near = graph.Adjacency(scratch, flat, graph.hubs_of(scratch, ends))
        rows = near.table.groupBy("src", "part").count().collect()
        assert sum(r.src == 0 for r in rows) == 6 and max(r["count"] for r in rows) < 100
        got = near.reached(spark.createDataFrame([(0, "x")], "node bigint, label string"))
        assert {r.node for r in got.collect()} == set(range(1, 301))
        front = spark.range(3000).withColumnRenamed("id", "node")
        assert near.reached(front)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def greedy(rows, t):
    kept, out = [], {}
    for turn, item, h in sorted(rows):
        near = sorted((apart(h, k[2]), k[0], k[1]) for k in kept if apart(h, k[2]) <= t) if h else []
        if near:
            out[item] = (False, near[0][2], near[0][0])
        else:
            out[item] = (True, None, None)
            if h:
                kept.append((turn, item, h))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_greedy_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = near_values(rng, 40, 5)
    rows = [(i, rng.choice([*pool, pool[0], pool[0], None, 0]), rng.random() < 0.3, rng.choice([0, 1, 5, None]), rng.choice(["a", "b", None])) for i in range(120)]
    from pyspark.sql import functions as F

    items = spark.createDataFrame(rows, "item_id bigint, hash bigint, military boolean, boxes int, stem string")
    items = items.withColumn("turn", neardup.priority(F.col("military"), F.col("boxes"), F.col("stem"), F.col("item_id")))
    order = [((not m, -(b or 0), (s is not None, s or ""), i), i, h) for i, h, m, b, s in rows]
    got = {r.item_id: (r.kept, r.rep_id, r.dist) for r in neardup.greedy_dedup(items).collect()}
    assert got == greedy(order, 3)


def test_no_chaining(spark):
    items = spark.createDataFrame([(1, 0b1 << 60, ), (2, 0b111 | 1 << 60), (3, 0b111111 | 1 << 60)], "item_id bigint, hash bigint")
    from pyspark.sql import functions as F

    rows = items.withColumn("turn", F.struct(F.col("item_id").alias("item")))
    assert sorted((r.item_id, r.kept) for r in neardup.greedy_dedup(rows).collect()) == [(1, True), (2, False), (3, True)]
    linked = neardup.single_linkage(items.selectExpr("*", "1 AS num_boxes", "false AS military", "'s' AS stem"))
    assert {r.cluster_id for r in linked.collect()} == {1} and linked.count() == 3


def test_empty(spark):
    rows = spark.createDataFrame([], "item_id bigint, hash bigint, turn struct<item: bigint>")
    assert neardup.greedy_dedup(rows).count() == 0
    assert hamming_join(spark.createDataFrame([], "hash bigint")).count() == 0
    assert neardup.single_linkage(spark.createDataFrame([], "item_id bigint, hash bigint, num_boxes int, military boolean, stem string")).count() == 0


@pytest.mark.parametrize("threshold", [None, 3])
def test_reject_near(spark, threshold):
    """Without a threshold the guard turns away all that are up to five bits from a held-out hash."""
    rng = random.Random(3)
    holdout = near_values(rng, 20)
    flip = lambda h, n: bits.signed((h & (2**64 - 1)) ^ sum(1 << p for p in rng.sample(range(64), n)))
    hashes = [*(flip(h, n) for h in holdout for n in range(8)), None, 0]
    candidates = spark.createDataFrame(list(enumerate(hashes)), "item_id bigint, hash bigint")
    given = {} if threshold is None else {"threshold": threshold}
    got = {r.item_id for r in neardup.reject_near(candidates, frame(spark, holdout), **given).collect()}
    assert got == {i for i, h in enumerate(hashes) if not h or all(apart(h, x) > (threshold or 5) for x in holdout)}


@pytest.mark.parametrize("total", [0, 25, 1000])
def test_audit_sample_spans_distances(spark, total):
    """Of 1,000 drops with 50 not exact, an even sample by distance holds exactly two of these."""
    far = {i: 1 + i % 3 for i in range(0, total, 20)}
    rows = [(i, -i, far.get(i, 0), i % 97 == 1, None) for i in range(total)]
    drops = spark.createDataFrame(rows, "item_id bigint, rep_id bigint, dist int, military boolean, rep_military boolean")
    order = sorted(rows, key=lambda r: (r[2], hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    even = {order[int(k * (total / 40))][0] for k in range(40)} if total else set()
    top = {r[0] for r in sorted((r for r in rows if r[3]), key=lambda r: (-r[2], r[0]))[:5]}
    got = neardup.audit_sample(drops).collect()
    assert {r.item_id for r in got} == even | top and len(got) == len(even | top)
    if total == 1000:
        assert sum(r.dist > 0 for r in got if r.item_id in even) == 2
