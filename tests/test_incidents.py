"""Folds, merges, streams, spatial joins and the lake against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, places, scoring, text
from tidewatch.operators import incidents, lake, ledger, release, spatial, views
from tidewatch.streaming import ordered, reports

BEGIN = 1_700_000_000.0
SPREAD = (0.0, 0.05, 0.11, 0.3)
PLACES = (None, "North mill", "South quay", "Old mill north", "quay")


def some_reports(n=400, seed=3, gap=900):
    rng = random.Random(seed)
    t, rows = [0.0] * 3, []
    for i in range(n):
        region = rng.randrange(3)
        t[region] += rng.choice((0, 60, 300, gap, 4 * gap))
        lat = rng.choice((None, 50.0, 50.0)) and 50.0 + rng.choice(SPREAD)
        rows.append((region, i, t[region], lat, lat and 30.0 + rng.choice(SPREAD), rng.random() < 0.1, rng.choice(PLACES), f"c{rng.randrange(6)}", f"text {i}", rng.choice([*ledger.RANKS]), rng.random() < 0.2, rng.random() < 0.3, rng.randrange(15, 100)))
    return rows


def naive_candidate(open_, r, veto):
    """The newest incident near by within 30 minutes, else the newest of its place text within 25."""
    found = None
    if r["lat"] is not None and not r["fallback"]:
        near = [i for i in open_ if i["t"] >= r["t"] - 1800 and i["lat"] is not None and math.hypot(i["lat"] - r["lat"], i["lon"] - r["lon"]) <= 0.08]
        found = near[-1] if near else None
    if found is None and r["place"] is not None:
        same = [i for i in open_ if i["t"] >= r["t"] - 1500 and i["place"] == r["place"]]
        found = same[-1] if same else None
    if veto and found and found["district"] and r["district"] and found["district"] != r["district"]:
        return None
    return found


NAMES = "region id t lat lon fallback place channel text event_type official media significance".split()
SCHEMA = "region int, id long, t double, lat double, lon double, fallback boolean, place string, channel string, text string, event_type string, official boolean, media boolean, significance int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_against_a_plain_loop(spark, seed):
    rows = [dict(zip(NAMES, r)) | {"fallback": False} for r in some_reports(seed=seed)]
    want, by_region = {}, {}
    for r in sorted(rows, key=lambda r: (r["region"], r["t"], r["id"])):
        open_ = by_region.setdefault(r["region"], [])
        found = naive_candidate(open_, r, False)
        if found is None:
            found = r | {"incident": r["id"]}
            open_.append(found)
        want[r["id"]] = found["incident"]
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA).repartition(5)
    assert {r.id: r.incident for r in incidents.cluster(df).collect()} == want
    assert incidents.cluster(df.limit(0)).count() == 0


def files_of(spark, rows, schema, path, n=4):
    """Rows in ``n`` files of a folder, in the order given, and one far later row that lets the watermark pass them all."""
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:02d}")
    return f"{path}/*"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream_of_incidents_equals_the_batch(spark, tmp_path, rocks):
    rows = [dict(zip(NAMES, r)) | {"t": BEGIN + r[2]} for r in some_reports(120, seed=8)]
    rows.sort(key=lambda r: r["t"])
    for k in range(0, len(rows) - 1, 3):  # within the watermark, out of order
        if rows[k + 1]["t"] - rows[k]["t"] < 300:
            rows[k], rows[k + 1] = rows[k + 1], rows[k]
    last = max(r["t"] for r in rows)
    make = lambda r: (r["region"], r["id"], r["t"], r["lat"], r["lon"], r["place"])
    schema = "region long, id long, t double, lat double, lon double, place string"
    batch = {r.id: r.incident for r in incidents.cluster(spark.createDataFrame([make(r) for r in rows], schema)).collect()}
    flush = [(r, 10_000 + r, last + 10_000, None, None, None) for r in range(3)]
    path = files_of(spark, [make(r) for r in rows] + flush, schema, str(tmp_path / "in"))
    stream = reports.read_reports(spark, path, 1, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    out = reports.run_available(ordered.incidents(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {r.id: r.incident for r in out.collect() if r.id < 10_000} == batch


def test_stream_of_alert_changes(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = [(rng.randrange(2), i, BEGIN + 60 * i, rng.choice((None, "ACTIVE", "CLEAR"))) for i in range(200)]
    state, want = {}, []
    for region, i, _, says in rows:
        before = state.get(region, "UNKNOWN")
        if says and says != before:
            want.append((region, i, before, says))
            state[region] = says
    late = [(0, 5000, BEGIN, "ACTIVE")]  # long behind the watermark: dropped
    schema = "region long, id long, t double, says string"
    path = files_of(spark, rows[:150] + rows[150:] + [(r, 9000, BEGIN + 60.0 * 200 + 9000, None) for r in range(2)] + late, schema, str(tmp_path / "in"), 5)
    stream = reports.read_reports(spark, path, 1, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    out = reports.run_available(ordered.alert_changes(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r.region, r.id, r.before, r.state) for r in out.collect()) == sorted(want)


def test_published_once_and_merged(spark, tmp_path):
    rows = [(i % 30, f"2024-01-01 00:{i % 30:02d}:00", 1, "x", 1.0, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    reports.publish(reports.read_reports(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c1"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == list(range(30))
    path = str(tmp_path / "lake")
    reports.merge_into(reports.read_reports(spark, str(tmp_path / "in"), 1), lambda b, _: lake.archive(spark, b, path, "event_id", "ts"), str(tmp_path / "c2"))
    assert spark.read.parquet(path).count() == 30
    query = reports.publish(reports.read_reports(spark, str(tmp_path / "in")), str(tmp_path / "log2"), str(tmp_path / "c3"), every="200 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "log2")).count() == 30


def test_repaired_json(spark):
    raw = ['{"event_id": 1, "ts": "2024-01-01", "user_id": "7", "value": "2.5",}', '```json\n{"event_id": "2"}\n```', "nothing", None]
    found = reports.parse_json(spark.createDataFrame([(r,) for r in raw], "value string")).collect()
    assert [(r.event_id, r.user_id, r.value, r.skip_reason) for r in found] == [(1, 7, 2.5, None), (2, None, None, None), (None, None, None, "invalid_json"), (None, None, None, "invalid_json")]
    assert found[2].raw == "nothing"


def test_radius_join_over_the_globe(spark):
    rng = random.Random(9)
    point = lambda: (rng.choice((rng.uniform(-90, 90), rng.uniform(80, 90), -89.99, 90.0)), rng.choice((rng.uniform(-180, 180), 179.97, -179.98, 180.0, -180.0)))
    left = [(i, *point()) for i in range(250)]
    right = [(i, *(point() if i % 2 else (max(-90.0, min(90.0, left[i][1] + rng.uniform(-0.3, 0.3))), left[i][2] + rng.uniform(-0.3, 0.3)))) for i in range(250)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    a, b = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "other_id long, lat double, lon double")
    for reach in (1.0, 50.0, 900.0):
        want = sorted((x[0], y[0]) for x in left for y in right if km(x, y) <= reach)
        assert sorted((r.id, r.other_id) for r in spatial.within_km(a, b, reach).collect()) == want, reach
    nearest = {}
    for x in left:
        nearest[x[0]] = min((km(x, y), y[0]) for y in right)[0]
    assert all(abs(r.km - nearest[r.id]) < 1e-6 for r in spatial.nearest(a, b, 1, 500.0).collect())


def test_lake_keeps_the_last_of_a_batch(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id long, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3)
    path = str(tmp_path / "lake")
    lake.archive(spark, make([(1, "2024-01-01 10:00:00", 1), (1, "2024-01-01 11:00:00", 2), (2, "2024-01-02 00:00:00", 3)]), path, "id", "ts")
    lake.archive(spark, make([(1, "2024-01-01 09:00:00", 4), (1, "2024-01-01 09:30:00", 5), (3, "2024-01-01 00:00:00", 6)]), path, "id", "ts")
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 5), (2, 3), (3, 6)]
    assert [p.name for p in tmp_path.iterdir()] == ["lake"]
    lake.replace_all(make([(1, "2024-01-01 00:00:00", 1)] * 2), str(tmp_path / "ref"))
    lake.replace_all(make([(9, "2024-01-01 00:00:00", 1)]), str(tmp_path / "ref"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ref")).collect()] == [9]
    lake.snapshot(make([(9, "2024-01-01 00:00:00", 1)]), str(tmp_path / "backup"), "d1")
    with pytest.raises(Exception, match="EXISTS"):
        lake.snapshot(make([]), str(tmp_path / "backup"), "d1")


def test_functions(spark):
    one = lambda *c: spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(c))).collect()[0]
    lit = F.lit
    assert one(text.signature(lit("Пожежа на вулиці Лесі, 12")), text.signature(lit("short")), text.signature(lit("a fire in the street"), lit("Old Mill")))[:] == ("пожежанавулицілесі12", None, "oldmill:afireinthestreet")
    assert one(text.slug(lit("вул. Лесі 1")), text.incident_id(lit("2024-01-02 03:04:05").cast("timestamp"), lit("Київ")))[:] == ("ВУЛЛЕСІ1", "INC-202401020304-КИЇВ")
    assert one(text.shown(lit("<b>a</b> & b\nJoin us now\n" + "x" * 20), 10, ["join us"]))[0] == "a &amp; b xxxx…"
    ok = [geo.valid_point(lit(a), lit(b), (44, 22, 52.5, 40.5), (50.2, 30.2, 50.6, 30.85)) for a, b in ((50.4, 30.5), (30.5, 50.4), (10.0, 10.0), (48.0, 30.0))]
    assert one(*ok, geo.valid_point(lit("x"), lit("1")), geo.valid_point(lit(None), lit(1.0)))[:] == ("ok", "axes_swapped", "out_of_range", "outside_scope", "not_numeric", "missing")
    speed, track, drift = geo.wind_triangle(lit(100.0), lit(90.0), lit(20.0), lit(0.0))
    there = geo.destination(lit(50.0), lit(30.0), lit(90.0), lit(100.0))
    got = one(geo.sound_delay_s(lit(3.313), lit(0.0)), speed, track, drift, geo.haversine_km(lit(50.0), lit(30.0), *there), geo.planar_degrees(lit(0.0), lit(0.0), lit(3.0), lit(4.0)), *geo.local_plane_km(lit(0.0), lit(0.0), lit(1.0), lit(1.0)))
    assert got[:] == pytest.approx((10.0, math.hypot(100, 20), 101.3099, 11.3099, 100.0, 5.0, 111.1949, 111.1949), abs=1e-3)
    assert one(scoring.fact_confidence(lit(0.5), lit(0.25), lit(0.75)), places.walking_minutes(lit(30.0)), places.walking_minutes(lit(1000.0)))[:] == (0.65, 1, 12)
    assert [tuple(x) for x in one(scoring.shares(F.array(F.struct(lit("a").alias("name"), lit(1.0).alias("weight")), F.struct(lit("b").alias("name"), lit(-3.0).alias("weight")))))[0]] == [("b", 75.0), ("a", 25.0)]
    conf = [scoring.confidence(*(lit(v) for v in x)) for x in ((2, 0.8, 0, 0, False, False), (2, 1.5, 0, 0, False, False), (1, 2.0, 1, 0, False, True), (0, 0.0, 0, 0, True, True), (1, 0.4, 0, 1, False, False))]
    assert one(*conf)[:] == (40, 85, 100, 35, 60)


def test_release_needs_a_salt(spark):
    rows = spark.createDataFrame([(i, 50.0, 30.0, 90, False, 1, "fire") for i in range(20)], "id long, lat double, lon double, confidence int, held boolean, region int, event_type string").withColumn("ts", F.timestamp_seconds("id"))
    done = spark.createDataFrame([(19,), (18,)], "id long")
    with pytest.raises(TypeError):
        release.released(rows, done, "2024-01-01")
    first, second = (sorted((r.id, r.rough_lat) for r in release.released(rows, done, "2024-01-01", s, batch=5).collect()) for s in ("a", "b"))
    assert [i for i, _ in first] == [13, 14, 15, 16, 17] and first != second


def test_view_of_no_window_is_empty(spark):
    rows = spark.createDataFrame([(1, "a", False)], "id long, channel string, is_fallback boolean").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [views.recent(rows, "2024-01-01", h).count() for h in (-1, 0, 0.5, 2)] == [0, 0, 1, 1]
