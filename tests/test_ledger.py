"""The incident ledger: fuzzed against the recursive SQL, groups against whole regions, and edge cases."""

import datetime
import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_oracle import plain
from tidewatch.operators import groups, ledger
from tidewatch.plans import incident_queries

BEGIN = datetime.datetime(2024, 1, 1)


def events(seed: int, n: int, users: int, step_s: int):
    rnd = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rnd.choice([0, step_s, step_s, 20 * step_s])
        rows.append((i, rnd.randrange(users), rnd.choice(["view", "signup", "error", "click", "purchase"]), float(rnd.randrange(0, 300)), f'{{"k": {rnd.randrange(100)}}}', BEGIN + datetime.timedelta(seconds=t)))
    return rows


@pytest.mark.parametrize(("seed", "users", "step_s"), [(1, 200, 300), (2, 16, 2000), (3, 60, 60), (4, 8, 8000)])
def test_against_the_recursive_query(spark, tmp_path, sf_dir, seed, users, step_s):
    """Sparse and dense tables, with few and many positions, repeats and takeovers."""
    df = spark.createDataFrame(events(seed, 500, users, step_s), "event_id long, user_id long, event_type string, value double, props string, ts timestamp_ntz")
    df.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("nation", "supplier"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("events", "nation", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("incident_merge", "reputation_as_of"):
        ours = incident_queries.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert plain(ours) == plain(con.execute(incident_queries.ORACLE[name]).df()), name


BASE = {
    "region": 1, "id": 0, "t": 0.0, "lat": 50.0, "lon": 30.0, "fallback": False, "place": "Mill", "district": None, "channel": "a", "message": None, "text": "x", "event_type": "fire", "rank": 3, "official": False,
    "media": False, "significance": 50, "weight": 0.4, "kind": "other", "reliability": 3, "credibility": 3, "reputation": 0.5, "radius_m": 2000.0, "heat": False, "recycled": False,
}
SCHEMA = (
    "region int, id long, t double, lat double, lon double, fallback boolean, place string, district string, channel string, message long, text string, event_type string, rank int, official boolean, media boolean, "
    "significance int, weight double, kind string, reliability int, credibility int, reputation double, radius_m double, heat boolean, recycled boolean"
)


def run(spark, *changes):
    rows = [BASE | {"id": i} | c for i, c in enumerate(changes)]
    return {r.incident: r for r in ledger.merged(spark.createDataFrame([tuple(r[k] for k in BASE) for r in rows], SCHEMA)).collect()}


def test_status_is_carried(spark):
    """A weak report does not take back what the first one had; trust from 85 on or an official report changes it."""
    got = run(spark, {"heat": True}, {"t": 60.0, "channel": "b"})
    assert (got[0].status, got[0].n, got[0].sources) == ("VERIFIED", 2, ["a", "b"])
    assert run(spark, {"recycled": True, "official": True}, {"t": 5.0, "channel": "b"})[0].status == "VERIFIED"  # an official incident's trust is 90
    assert run(spark, {"recycled": True}, {"t": 5.0, "channel": "b"})[0].status == "DISPUTED"
    assert run(spark, {"recycled": True, "heat": True})[0].status == "DISPUTED"
    assert run(spark, {}, {"t": 9.0, "channel": "b", "official": True})[0].source == "b"


def test_positions_move(spark):
    """A merged position is where the next report is measured from, and the window stays where it began."""
    got = run(spark, {}, {"t": 60.0, "lat": 50.07, "radius_m": 50.0, "channel": "b"}, {"t": 120.0, "lat": 50.14, "place": "Far", "channel": "c"}, {"t": 1801.0, "lat": 50.07, "place": None})
    assert set(got) == {0, 3} and got[0].n == 3 and got[0].lat > 50.069
    assert run(spark, {}, {"t": 60.0, "lat": 50.14, "place": "Far"}).keys() == {0, 1}
    apart = run(spark, {}, {"t": 60.0, "lat": 51.0})
    assert (apart[0].n, apart[0].lat) == (2, 50.0)


def test_conflicts(spark):
    """Facts that are trusted but exact, and far from the centre, dispute an incident until its trust settles it."""
    sure = {"reliability": 6, "credibility": 1, "radius_m": 60.0}
    far = run(spark, sure, sure | {"t": 1.0, "lat": 50.05, "channel": "b"})[0]
    assert far.conflicts == 2 and far.status == "VERIFIED"  # trust 88
    unsure = {"reliability": 5, "credibility": 3, "radius_m": 60.0}
    assert run(spark, unsure, unsure | {"t": 1.0, "lat": 50.05, "channel": "b"})[0].status == "DISPUTED"


def test_repeats(spark):
    """A repeat of the message an incident stands for raises it, within its window and after; others change nothing."""
    got = run(spark, {"message": 7}, {"message": 7, "t": 60.0, "significance": 90, "event_type": "explosion"}, {"message": 8, "t": 70.0, "channel": "b"}, {"message": 8, "t": 80.0, "channel": "b", "significance": 99})
    assert (got[0].n, got[0].significance, got[0].event_type) == (2, 90, "explosion") and len(got) == 1
    late = run(spark, {"message": 7}, {"message": 7, "t": 9000.0, "significance": 77, "event_type": "explosion", "media": True}, {"message": 7, "t": 9500.0, "significance": 70, "event_type": "fire"})
    assert len(late) == 1 and (late[0].n, late[0].significance, late[0].event_type) == (1, 77, "fire")
    assert late[0].resonance == min(100, math.floor(0.55 * 77 + 0.45 * late[0].confidence))


def test_nulls(spark):
    """Nulls in every column but region, id and t; reports without position and place stand alone."""
    empty = {k: None for k in BASE if k not in ("region", "id", "t")}
    got = run(spark, empty, empty | {"t": 1.0}, empty | {"t": 2.0, "place": "Mill"}, empty | {"t": 3.0, "place": "Mill"}, {"t": 4.0, "fallback": True}, {"t": 5.0, "lat": 50.01})
    assert sum(r.n for r in got.values()) == 6 and len(got) == 3 and got[2].n == 4
    assert ledger.merged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_split_a_busy_region(spark):
    """A region without a gap in time is many groups, and no incident of the whole region's fold has reports of two."""
    rnd = random.Random(5)
    rows = [
        BASE | {"id": i, "t": i * 20.0, "lat": 50 + rnd.randrange(40) / 4 + rnd.random() / 9, "lon": 30 + rnd.randrange(40) / 4 + rnd.random() / 9, "place": rnd.choice([None, f"p{rnd.randrange(900)}"]), "fallback": rnd.random() < 0.1}
        for i in range(3000)
    ]
    df = spark.createDataFrame([tuple(r[k] for k in BASE) for r in rows], SCHEMA)
    whole, state, done = {}, ledger.Ledger(), []
    for r in rows:
        done += state.close(r["t"])
        state.add(r | {"repeat": False})
    for i in [*done, *state.open.values()]:
        whole[i["incident"]] = (i["n"], round(i["lat"], 6), i["confidence"], i["status"])
    assert {r.incident: (r.n, round(r.lat, 6), r.confidence, r.status) for r in ledger.merged(df).collect()} == whole
    sizes = [r["count"] for r in groups.grouped(df, ledger.WINDOW_S, ledger.REACH).groupBy("_group").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 600


def test_connected(spark):
    """Long paths, stars, loops and nulls."""
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.group for r in groups.connected(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1040)} | {2000: 2000, 2001: 2000}


def test_a_dense_stretch_is_linear():
    """Twice the reports in one stretch, with incidents all around, take about twice the time."""

    def seconds(n: int) -> float:
        rnd, state = random.Random(1), ledger.Ledger()
        began = time.process_time()
        for i in range(n):
            t = i * 1800.0 / n * 4
            state.close(t)
            state.add(BASE | {"id": i, "t": t, "lat": 50 + rnd.random() * n / 2000, "lon": 30 + rnd.random() * 2, "place": f"p{rnd.randrange(n)}", "district": rnd.choice("ab"), "repeat": False})
        return time.process_time() - began

    seconds(500)
    assert seconds(16000) < 5 * seconds(8000)


def test_assets_and_codes(spark):
    got = ledger.merged(spark.createDataFrame([tuple((BASE | {"id": 3, "t": 1.7e9})[k] for k in BASE), tuple((BASE | {"id": 4, "t": 1.8e9, "event_type": "general_alert"})[k] for k in BASE)], SCHEMA))
    assets = spark.createDataFrame([(1, "bridge", "Old", 50.001, 30.0), (2, "school", "New", 50.002, 30.0), (3, "x", "y", None, None)], "asset_id long, kind string, name string, lat double, lon double")
    rows = {r.incident: r for r in ledger.with_assets(ledger.with_codes(got), assets).collect()}
    assert rows[3].asset == "bridge: Old (111 m)" and rows[4].asset is None and rows[3].code == "INC-202311142213-MILL"


def test_reputations_against_a_loop(spark):
    """Reviews at the same and at earlier times, long pauses, unknown and null channels."""
    rnd = random.Random(9)
    reviews = [(rnd.choice(["a", "b", None]), rnd.choice([0.0, 1e6, 1e7]) + rnd.randrange(0, 9000, 600), rnd.random() < 0.6) for _ in range(120)] + [("a", None, True), ("a", 5.0, None)]
    reports = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([-1e6, 0.0, 1e6, 1e7, 3e8]) + rnd.randrange(0, 9000, 300)) for i in range(200)]
    got = {r.id: r.reputation for r in ledger.reputations(spark.createDataFrame(reports, "id long, channel string, t double"), spark.createDataFrame(reviews, "channel string, t double, confirmed boolean")).collect()}
    for i, channel, t in reports:
        a = b = 2.0
        last = None
        for _, at, ok in sorted((r for r in reviews if (r[0] or "") == (channel or "") and r[1] is not None and r[2] is not None and r[1] <= t), key=lambda r: r[1]):
            if last is not None:
                a, b = (2 + (x - 2) * 0.5 ** ((at - last) / ledger.HALF_LIFE_S) for x in (a, b))
            a, b, last = a + ok, b + (not ok), at
        assert abs(got[i] - a / (a + b)) < 1e-9
