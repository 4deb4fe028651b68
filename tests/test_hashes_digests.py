"""Hash neighbours, digests by rounds, space-time nearest, archive before prune, edge merges and gates against plain loops."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import hashes, incidents, lake, quality, spatial


@pytest.mark.parametrize("lookback", [7, 500])
def test_newest_like(spark, lookback):
    """Any number of flipped bits, equal hashes, equal times, nulls, negative hashes."""
    rnd = random.Random(lookback)
    centres = [rnd.randrange(1 << 64) for _ in range(4)]
    rows = []
    for i in range(400):
        h = rnd.choice(centres)
        for b in rnd.sample(range(64), rnd.choice([0, 1, 3, 5, 6, 9])):
            h ^= 1 << b
        rows.append((i, float(rnd.randrange(0, 90) * 86400 // 2), h - (1 << 64) if h >> 63 else h))
    df = spark.createDataFrame([*rows, (900, None, 1), (901, 1.0, None)], "id long, t double, hash long").repartition(5)
    want = {}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for n, (i, t, h) in enumerate(order):
        for j, u, g in reversed(order[max(0, n - lookback) : n]):
            if u >= t - 30 * 86400 and ((h ^ g) & ((1 << 64) - 1)).bit_count() <= 5:
                want[i] = (j, ((h ^ g) & ((1 << 64) - 1)).bit_count())
                break
    assert {r.id: (r.other_id, r.bits) for r in hashes.newest_like(df, lookback).collect()} == want and want
    flagged = hashes.with_recycled(df)
    assert flagged.count() == 402 and hashes.newest_like(df.limit(0)).count() == 0
    if lookback == 500:
        assert {r.id for r in flagged.where("recycled").collect()} == set(want)


def test_segments_cover_all_bits(spark):
    row = spark.range(1).select(hashes.segments(F.lit(-1).cast("long")).alias("s")).first().s
    assert sum(p.v.bit_count() for p in row) == 64 and len(row) == 6


@pytest.mark.parametrize("folded", [0, 30, 10**6])
def test_digest_by_rounds(spark, folded):
    """However many rows are left to the last fold, the rows kept are those of a plain loop; null keys and values too."""
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", None, "b"]), i, rnd.choice([None, float(rnd.randrange(60))]), rnd.choice([None, rnd.randrange(25)]), rnd.choice([None, f"s{rnd.randrange(25)}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "window string, id long, t double, incident long, signature string").repartition(4)
    want, seen = set(), {}
    for w, i, t, inc, sig in sorted(rows, key=lambda r: (r[0] or "~", r[2] is None, r[2] or 0, r[1])):
        incs, sigs = seen.setdefault(w, (set(), set()))
        if (inc is None or inc not in incs) and (sig is None or sig not in sigs):
            want.add(i)
            incs.add(inc)
            sigs.add(sig)
    assert {r.id for r in incidents.unseen(df, ["window"], folded).collect()} == want


@pytest.mark.parametrize("hot", [50_000, 3])
def test_nearest_in_time_over_the_globe(spark, hot):
    rnd = random.Random(3)
    at = lambda: (rnd.choice([rnd.uniform(-90, 90), rnd.uniform(60, 64), rnd.uniform(84, 90)]), rnd.choice([rnd.uniform(-180, 180), 179.9, -179.9, 10.0 + rnd.random()]))
    left = [(i, float(rnd.randrange(0, 20000)), *at()) for i in range(300)] + [(900, None, 1.0, 1.0), (901, 5.0, None, 1.0)]
    right = [(i, float(rnd.randrange(0, 20000)), *at()) for i in range(300)]
    got = spatial.nearest_in_time(spark.createDataFrame(left, "id long, t double, lat double, lon double"), spark.createDataFrame(right, "other_id long, t double, lat double, lon double"), 300.0, 4000.0, hot)

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * geo.RADIUS_KM * math.asin(math.sqrt(min(1.0, x)))

    want = {}
    for i, t, lat, lon in left[:300]:
        near = [(round(km(lat, lon, *r[2:]), 3), r[0]) for r in right if abs(r[1] - t) <= 4000]
        near = [x for x in near if x[0] <= 300]
        if near:
            want[i] = min(near)
    found = {r.id: (r.km, r.other_id) for r in got.collect()}
    assert found.keys() == want.keys() and len(want) > 50
    assert all(abs(found[i][0] - want[i][0]) < 0.002 for i in want)


def test_prune_only_what_is_archived(spark, tmp_path):
    now = datetime.datetime(2024, 6, 1)
    old = now - datetime.timedelta(days=2)
    rows = [(1, old, 10, False, "NEW"), (2, old, 90, False, "NEW"), (3, now, 10, False, "NEW"), (None, old, 10, False, "NEW"), (4, now - datetime.timedelta(days=100), 90, False, "NEW")]
    table = spark.createDataFrame(rows, "id long, ts timestamp, significance int, physical boolean, stage string")
    left = lake.archive_and_prune(spark, table, f"{tmp_path}/lake", "id", "ts", now)
    assert sorted(((r.id, r.stage) for r in left.collect()), key=str) == [(2, "NEW"), (3, "NEW"), (4, "ARCHIVED"), (None, "NEW")]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/lake").collect()) == [1, 2, 3, 4]


def test_edges_merge(spark):
    edges = spark.createDataFrame([("a", "b", 3, 5, 9, "old"), ("x", "y", 1, 1, 1, None)], "source string, target string, weight long, first_seen long, last_seen long, sample string")
    fresh = spark.createDataFrame([(" @A ", "b", 12, None), ("a", "B", 2, "z" * 600), ("@c", "c", 1, "t"), ("", "b", 1, "t"), (None, "b", 1, "t"), ("n", "m", 4, "")], "source string, target string, ts long, text string")
    got = {(r.source, r.target): tuple(r)[2:] for r in lake.merge_edges(edges, fresh).collect()}
    assert got == {("a", "b"): (5, 2, 12, "z" * 500), ("x", "y"): (1, 1, 1, None), ("n", "m"): (1, 4, 4, None)}


def test_rates_and_gates(spark):
    none = spark.createDataFrame([], "sources array<string>, official boolean")
    assert tuple(quality.consensus(none).first()) == (0, 0, 0, None)
    two = spark.createDataFrame([(["a", "b"], True), (["a"], False), ([], None)], "sources array<string>, official boolean")
    assert tuple(quality.consensus(two).first()) == (3, 1, 1, 33.3)
    reviews = spark.createDataFrame([("CONFIRMED_ANALYST",), ("DISCARDED_NOISE",), ("CONFIRMED_ANALYST",), (None,), ("OPEN",)], "decision string")
    assert tuple(quality.review_hits(reviews).first()) == (2, 1, 66.7)
    judged = spark.createDataFrame([(True, True)] * 9 + [(True, None)] + [(False, True), (None, True), (False, False)], "expected boolean, predicted boolean")
    assert tuple(quality.gates(judged).first()) == (9, 1, 1, 1, 0.9, 0.9, 0.9, "pass")
    assert quality.gates(judged.where("expected is null or not expected")).first().advice == "widen,narrow"
