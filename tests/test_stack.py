"""Scene grouping: the unit cases, and random photos against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstpick import scan
from burstpick.operators import anchors, stack

SCHEMA = "image_id long, ts_ms long, phash long, shoot long"


def photos(spark, rows):
    return spark.createDataFrame([(*r, None, 0)[:4] if len(r) == 2 else (*r, 0) for r in rows], SCHEMA)


def scenes(df, gap=3.0, bits=14, by=("shoot",)):
    found = {}
    for r in stack.stack_scenes(df, gap, bits, list(by)).orderBy("scene_id", "pos_in_scene").collect():
        found.setdefault(r["scene_id"], []).append(r["image_id"])
    assert list(found) == list(range(1, len(found) + 1))
    return list(found.values())


def loop(rows, gap, bits):
    timed = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    out, last, anchor = [], None, None
    for i, ts, h in timed:
        if last is None or ts - last > gap * 1000:
            out.append([i])
            anchor = h
        elif anchor is not None and h is not None and bin((anchor ^ h) & (2**64 - 1)).count("1") > bits:
            out.append([i])
            anchor = h
        else:
            out[-1].append(i)
        last = ts
    return out + [[i] for i, ts, _ in sorted(rows) if ts is None]


CASES = {
    "single": ([(1, 1000)], 3.0, [[1]]),
    "tight": ([(1, 1000), (2, 1200), (3, 1400), (4, 1600), (5, 1800)], 3.0, [[1, 2, 3, 4, 5]]),
    "two bursts": ([(1, 0), (2, 200), (3, 400), (4, 5000), (5, 5200), (6, 5400)], 3.0, [[1, 2, 3], [4, 5, 6]]),
    "nulls": ([(1, 1000), (2, 1200), (3, None), (4, None)], 3.0, [[1, 2], [3], [4]]),
    "half a second": ([(1, 0), (2, 300), (3, 900), (4, 1100)], 0.5, [[1, 2], [3, 4]]),
    "unsorted": ([(3, 400), (1, 0), (5, 5200), (2, 200), (4, 5000)], 3.0, [[1, 2, 3], [4, 5]]),
    "large gaps": ([(1, 0), (2, 10000), (3, 20000), (4, 30000)], 3.0, [[1], [2], [3], [4]]),
    "chain": ([(i + 1, i * 100) for i in range(20)], 3.0, [list(range(1, 21))]),
    "gap as the threshold": ([(1, 0), (2, 3000)], 3.0, [[1, 2]]),
    "over the threshold": ([(1, 0), (2, 3001)], 3.0, [[1], [2]]),
    "equal times": ([(2, 5), (1, 5)], 3.0, [[1, 2]]),
    "missing anchor": ([(1, 0, None), (2, 1, 0), (3, 2, -1)], 3.0, [[1, 2, 3]]),
    "missing inside": ([(1, 0, 0), (2, 1, None), (3, 2, (1 << 15) - 1)], 3.0, [[1, 2], [3]]),
    "14 bits": ([(1, 0, 0), (2, 1, (1 << 14) - 1)], 3.0, [[1, 2]]),
    "15 bits": ([(1, 0, 0), (2, 1, (1 << 15) - 1)], 3.0, [[1], [2]]),
    "back to the first look": ([(1, 0, 0), (2, 1, -1), (3, 2, 0)], 3.0, [[1], [2], [3]]),
}


def test_cases_by_shoot(spark):
    """Each case as a shoot of its own."""
    rows = [(100 * n + i, ts, *h, n) if h else (100 * n + i, ts, None, n) for n, (own, _, _) in enumerate(CASES.values()) for i, ts, *h in own]
    df = spark.createDataFrame(rows, SCHEMA)
    for gap in {c[1] for c in CASES.values()}:
        of = {r["image_id"]: (r["scene_id"], r["pos_in_scene"]) for r in stack.stack_scenes(df, gap, 14, ["shoot"]).collect()}
        for n, (name, (own, own_gap, want)) in enumerate(CASES.items()):
            if own_gap == gap:
                found = {}
                for i in sorted((r[0] for r in own), key=lambda i: of[100 * n + i]):
                    found.setdefault(of[100 * n + i][0], []).append(i)
                assert sorted(found.values()) == sorted(want), name


def test_cases_without_key(spark):
    """All cases one after another, far apart in time; those without a time last."""
    for gap in {c[1] for c in CASES.values()}:
        rows, want, late = [], [], []
        for n, (own, own_gap, scenes_of) in enumerate(CASES.values()):
            if own_gap == gap:
                rows += [(100 * n + r[0], None if r[1] is None else r[1] + n * 10**7, *r[2:]) for r in own]
                none = {r[0] for r in own if r[1] is None}
                want += [[100 * n + i for i in x] for x in scenes_of if not none & set(x)]
                late += [[100 * n + i for i in x] for x in scenes_of if none & set(x)]
        assert scenes(photos(spark, rows), gap, by=()) == want + late


def test_empty(spark):
    df = photos(spark, [(1, 1)]).limit(0)
    assert scenes(df) == []
    assert stack.scene_stats(stack.stack_scenes(df, 3.0, 14, ["shoot"])).first().asDict() == {"scenes": 0, "singletons": 0, "largest": 0, "average_size": 0.0}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 17)])
def test_random(spark, seed, parts):
    rng = random.Random(seed)
    looks = [rng.getrandbits(63) for _ in range(3)]
    rows = [(i, rng.choice([None] + [rng.randint(0, 60_000)] * 12), rng.choice([None] + [rng.choice(looks) ^ (1 << rng.randint(0, 40))] * 6)) for i in range(1, 300)]
    rng.shuffle(rows)
    df = photos(spark, rows).repartition(parts)
    want = loop(rows, 0.4, 14)
    assert scenes(df, 0.4) == want
    assert scenes(df, 0.4, by=()) == want


@pytest.fixture()
def many_parts(spark):
    """Range partitions stay as many as they are planned, small as they are."""
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_over_partitions(spark, many_parts, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([rng.randint(0, 9_000), rng.randint(900_000, 909_000)]), None, rng.choice([None, 1, 1, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for by in ([], ["shoot"]):
        want = {}
        for shoot in {r[3] if by else 0 for r in rows}:
            cluster, last = 0, None
            for i, ts, *_ in sorted((r for r in rows if not by or r[3] == shoot), key=lambda r: (r[1], r[0])):
                cluster += last is not None and ts - last > 100
                want[i], last = cluster, ts
        assert {r["image_id"]: r["cluster"] for r in stack.time_clusters(df, 0.1, by).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_segments_over_partitions(spark, many_parts, seed):
    """One key with nearly all rows, and ties: numbers, runs and first rows against a plain loop."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), rng.randint(0, 150), i) for i in range(250)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    got = scan.segmented(df, ["k"], ["v", "i"], ["i"], ("v", 2)).collect()
    want, key, last = {}, object(), None
    for k, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if k != key:
            key, run, nth, head = k, 0, 0, i
        elif v - last > 2:
            run, nth, head = run + 1, 0, i
        nth, last = nth + 1, v
        want[i] = (run, nth, head)
    assert {r["i"]: (r["_run"], r["_nth"], r["_head"]["i"]) for r in got} == want
    assert scan.segmented(df.limit(0), ["k"], ["v", "i"], ["i"]).count() == 0


LOOKS = {
    "two looks": lambda rng, i: (0, -1)[i // 40 % 2],
    "random": lambda rng, i: rng.getrandbits(63),
    "slow drift": lambda rng, i: (1 << (i // 9 % 60)) - 1,
    "still, then a change": lambda rng, i: 5 if i < 290 else -1,
    "near the bound": lambda rng, i: sum(1 << b for b in rng.sample(range(20), 8)),
    "missing ones": lambda rng, i: rng.choice([None, None, 0, -1, 3]),
    "nothing known": lambda rng, i: None,
}


def test_clusters_of_all_looks(spark, many_parts):
    """Clusters of one shoot each, all over several partitions: the chains of the plain loop."""
    rng = random.Random(4)
    rows = [(1000 * n + i, i * 10, LOOKS[look](rng, i), n) for n, look in enumerate(LOOKS) for i in range(300)]
    found = {}
    for r in stack.stack_scenes(spark.createDataFrame(rows, SCHEMA), 3.0, 14, ["shoot"]).orderBy("scene_id", "pos_in_scene").collect():
        found.setdefault(r["shoot"], {}).setdefault(r["scene_id"], []).append(r["image_id"])
    assert {n: list(x.values()) for n, x in found.items()} == {n: loop([r[:3] for r in rows if r[3] == n], 3.0, 14) for n in range(len(LOOKS))}


@pytest.mark.parametrize("look", ["near the bound", "slow drift"])
def test_one_cluster_of_all_rows(spark, many_parts, look):
    """A single cluster over all partitions."""
    rng = random.Random(look)
    rows = [(i, i * 10, LOOKS[look](rng, i)) for i in range(300)]
    assert scenes(photos(spark, rows)) == loop(rows, 3.0, 14)


def test_first_photo_without_hash_over_partitions(spark, many_parts):
    rows = [(i, i * 10, None if i == 0 else -(i % 2)) for i in range(200)] + [(500 + i, 10**6 + i, -(i % 2)) for i in range(100)]
    assert scenes(photos(spark, rows)) == loop(rows, 3.0, 14)


def test_one_cluster_is_many_tasks(spark, many_parts):
    """Of one cluster in one day: the walk of its rows is dealt to partitions, none of which holds a large share."""
    df = photos(spark, [(i, i, -(i // 7 % 2)) for i in range(2_000)])
    clusters = stack.time_clusters(df, 3.0, ["shoot"])
    assert clusters.select("cluster").distinct().count() == 1
    split = stack.split_by_phash(clusters, 14, ["shoot"])
    sizes = [r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000 and len(sizes) >= 8 and max(sizes) < 700
    assert split.select("subgroup").distinct().count() == 286


def test_no_window_over_a_scene(spark):
    df = photos(spark, [(i, i * 40_000_000) for i in range(10)])
    plan = stack.stack_scenes(df, 3.0, 14, ["shoot"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_successors(seed):
    rng = random.Random(seed)
    bits = np.array([rng.getrandbits(6) if seed else i // 70 for i in range(200)], np.uint64)
    known = np.array([rng.random() < 0.8 for _ in bits])
    want = [next((j for j in range(i + 1, 200) if known[i] and known[j] and int(bits[i] ^ bits[j]).bit_count() > 1), -1) for i in range(200)]
    assert anchors.successors(bits, known, 1).tolist() == want
    to, steps = anchors.leaving(np.array(want))
    for i in range(200):
        at, n = i, 0
        while want[at] >= 0:
            at, n = want[at], n + 1
        assert (to[i], steps[i]) == (at, n)


def test_long_cluster_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(i, i, (0 if i // 10 % 2 else -1)) for i in range(100)]
        assert scenes(photos(spark, rows)) == loop(rows, 3.0, 14)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_and_large_keys(spark):
    """Photos without a shoot are a shoot, and ids beyond 53 bits stay whole beside nulls."""
    big = 2**60 + 1
    rows = [(1, 0, 0, None), (2, 10, -1, None), (3, 20, -1, None), (4, 0, 0, big), (5, 10, 0, big), (6, 10, 0, big + 1), (7, None, 0, None), (8, 90_000, 0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert scenes(df) == [[1], [4, 5], [2, 3], [6], [8], [7]]
    assert {(r["shoot"], r["image_id"]) for r in stack.stack_scenes(df, 3.0, 14, ["shoot"]).collect()} == {(r[3], r[0]) for r in rows}


def test_times_in_seconds(spark):
    """A gap of 3 s is one of 3 s in either unit."""
    rows = [(1, 0), (2, 3), (3, 7), (4, None)]
    told = lambda df, unit: sorted(tuple(r) for r in stack.stack_scenes(df, 3.0, 14, [], unit).collect())
    assert told(photos(spark, rows), "s") == told(photos(spark, [(i, None if t is None else 1000 * t) for i, t in rows]), "ms") == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (3, 1, 4)]
    with pytest.raises(ValueError):
        stack.stack_scenes(photos(spark, rows), 3.0, 14, [], "us")
