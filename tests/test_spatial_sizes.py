"""Spatial joins whose rows crowd: many ids of one position, dense and empty areas."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import spatial

LEFT, RIGHT = "id long, lat double, lon double", "other_id long, lat double, lon double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_nearest_of_crowded_positions(spark):
    """60,000 by 60,000 ids at ten positions a side: pairs of ids would be 3.6e9."""
    began = time.time()
    spot = lambda shift: (F.lit(50.0) + F.col("n") % 10 / 1000.0, F.lit(30.0) + shift)
    n = spark.range(60_000).withColumnRenamed("id", "n")
    left = n.select(F.col("n").alias("id"), spot(0.0)[0].alias("lat"), spot(0.0)[1].alias("lon"))
    right = n.select(F.col("n").alias("other_id"), spot(0.001)[0].alias("lat"), spot(0.001)[1].alias("lon"))
    got = spatial.nearest(left, right, 3, 60.0)
    # The ids of a position are those of one remainder; the nearest are the three least of the same.
    want = got.where((F.col("other_id") == F.col("id") % 10 + 10 * (F.col("place") - 1)))
    assert got.count() == want.count() == 180_000
    assert time.time() - began < 90


def test_nearest_of_dense_and_empty_areas(spark):
    rng = random.Random(3)
    dense = lambda: (50 + rng.gauss(0, 0.001), 30 + rng.gauss(0, 0.001))
    left = [(i, *(dense() if i % 2 else (rng.uniform(-90, 90), rng.uniform(-180, 180)))) for i in range(120)] + [(900, None, 1.0)]
    right = [(i, *(dense() if i % 10 else (rng.uniform(-90, 90), rng.uniform(-180, 180)))) for i in range(600)] + [(900, 1.0, None)]
    right += [(1000 + i, *right[i][1:]) for i in range(50)]
    got = {}
    for r in spatial.nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 4, 60.0).collect():
        got.setdefault(r.id, []).append((r.place, r.other_id, r.km))
    assert sorted(got) == list(range(120))
    for x in left[:-1]:
        want = sorted((round(km(x, y), 6), y[0]) for y in right if y[2] is not None)[:4]
        assert [(o, pytest.approx(d, abs=1e-6)) for _, o, d in sorted(got[x[0]])] == [(o, d) for d, o in want]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_radius_join_of_crowded_positions(spark, most):
    left = [(i, 50.0 + i % 4 / 10, 30.0) for i in range(40)] + [(99, None, 30.0)]
    right = [(i, 50.0 + i % 3 / 10, 30.1) for i in range(90)] + [(None, 50.0, 30.1), (98, 50.0, None)]
    got = spatial.within_km(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), 15.0, 3, most)
    assert got.columns == ["id", "lat", "lon", "other_id", "km"]
    want = [(x[0], y[0], round(km(x, y), 3)) for x in left[:-1] for y in right[:-1] if km(x, y) <= 15]
    key = lambda r: (r[0], -1 if r[1] is None else r[1], r[2])
    assert sorted(((r.id, r.other_id, r.km) for r in got.collect()), key=key) == sorted(want, key=key)


def test_nearest_in_time_of_one_crowd(spark):
    """20,000 by 20,000 rows at two positions within the reach of each other: pairs would be 4e8. Times are a step apart, so the least id in reach is the first in time."""
    began = time.time()
    n = spark.range(20_000).withColumnRenamed("id", "n")
    rows = n.select("n", (F.col("n") * 2.0).alias("t"), F.lit(50.0).alias("lat"), (F.lit(30.0) + F.col("n") % 2 / 1000.0).alias("lon"))
    got = spatial.nearest_in_time(rows.withColumnRenamed("n", "id"), rows.withColumnRenamed("n", "other_id"), 60.0, 10_000.0, 1000)
    # Ids of the same remainder are at distance 0; 5,000 steps of two seconds reach back.
    least = F.greatest(F.col("id") % 2, F.col("id") - 5000)
    assert got.count() == got.where((F.col("other_id") == least) & (F.col("km") == 0)).count() == 20_000
    assert time.time() - began < 90
