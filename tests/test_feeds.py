"""Readers over files written here, the smoother and the digest against plain loops, and streams against batches."""

import json

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import places
from tidewatch.operators import incidents, tracks
from tidewatch.sources import feeds


def keep_unseen(pdf):
    """Rows of one window, in order, whose incident and signature were on no row kept before: a plain loop."""
    pdf = pdf.sort_values(["t", "id"], kind="stable")
    seen, signed, kept = set(), set(), []
    for r in pdf.itertuples():
        new = r.incident not in seen and (r.signature is None or r.signature not in signed)
        kept.append(new)
        if new:
            seen.add(r.incident)
            if r.signature is not None:
                signed.add(r.signature)
    return pdf[kept]


def test_json_reports_keep_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"channel": "x", "message_id": 1, "ts": "2024-01-01T00:00:00", "text": "t", "fwd_id": 9}\nnot json\n')
    rows = feeds.json_reports(spark, str(tmp_path / "a.json")).select("channel", "source", "bad").collect()
    assert sorted(map(tuple, rows), key=str) == [("x", "9", None), (None, None, "not json")]


def test_thermal_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("latitude,longitude,bright_ti4,acq_date,acq_time,confidence,frp\n48,30,310,2024-05-01,930,n,20\n48,30,310,2024-05-01,9x,n,20\n10,30,310,2024-05-01,0000,n,1\n")
    rows = feeds.thermal_csv(spark, str(tmp_path / "t.csv"), (44, 22, 52, 40)).select(F.date_format("ts", "HH:mm")).collect()
    assert sorted((r[0] for r in rows), key=str) == ["09:30", None]


def test_registry_geojson_and_rss(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "@City_News ", "weight": 0.9}, {"name": "b"}], indent=1))
    assert sorted(r.name for r in feeds.registry(spark, str(tmp_path / "r.json")).collect()) == ["b", "city_news"]
    point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [30.5, 50.4]}, "properties": {"name": "s"}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point]}, indent=1))
    assert [tuple(r) for r in feeds.geojson_points(spark, str(tmp_path / "g.json")).collect()] == [("s", 50.4, 30.5)]
    item = "<item><title>{0}</title><link>l{1}</link><pubDate>Mon, {1} Jan 2024 10:00:00 GMT</pubDate></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format("Flood warning", "02") + item.format("Flood", "01") + item.format("Sport", "02") + "</channel></rss>")
    rows = feeds.rss_items(spark, str(tmp_path / "f.xml"), "2024-01-02 12:00:00", 24, ["flood"]).collect()
    assert [r.link for r in rows] == ["l02"]


def test_audit_hashes_addresses(spark, tmp_path):
    for _ in range(2):
        feeds.append_audit(spark.createDataFrame([("10.0.0.1", "read")], "ip string, action string"), str(tmp_path / "audit"), "ip", "salt")
    rows = spark.read.parquet(str(tmp_path / "audit")).collect()
    assert len(rows) == 2 and all(len(r.ip) == 64 for r in rows)


def test_addresses(spark):
    df = spark.createDataFrame([("At rue Lilas, 12b and Elm street",), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(places.addresses(F.col("text"))).collect()]
    assert [(a.street, a.building) for a in got[0]] == [("rue Lilas", "12b")] or [(a.street, a.building) for a in got[0]] == [("rue Lilas", "12b"), ("Elm street", None)]
    assert got[1] == [] and got[2] is None


def test_smoother_follows_a_line_and_ignores_arrival_order(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, 600.0 * i, float(10 * i + rng.normal()), float(5 * i + rng.normal())) for i in range(60)] + [(1, 99, None, 0.0, 0.0)]
    make = lambda r: tracks.smooth(spark.createDataFrame(r, "track long, id long, t double, x double, y double"), 1.0, 5.0)
    first, second = (sorted(map(tuple, make(r).collect())) for r in (rows, rows[::-1]))
    assert first == second and len(first) == 60
    assert abs(first[-1][4] - 60) < 3 and abs(first[-1][5] - 30) < 3


def test_smoother_starts_anew_after_quiet(spark):
    rows = [(1, i, 600.0 * i + (0 if i < 3 else 50_000), float(i), 0.0) for i in range(5)]
    out = sorted(map(tuple, tracks.smooth(spark.createDataFrame(rows, "track long, id long, t double, x double, y double")).collect()))
    assert out[3][4] == 0.0 and out[2][4] != 0.0
    assert tracks.smooth(spark.createDataFrame([], "track long, id long, t double, x double, y double")).count() == 0


def test_digest_registers_only_what_it_keeps(spark):
    rows = [(1, 1, 10, "a"), (2, 2, 10, "b"), (3, 3, 11, "b"), (4, 4, 11, "a")]
    df = spark.createDataFrame(rows, "id long, t long, incident long, signature string").withColumn("g", F.lit(1))
    assert sorted(r.id for r in df.groupBy("g").applyInPandas(keep_unseen, df.schema).collect()) == [1, 3]


def test_digest_folds_batches_like_the_whole_window(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(40)), int(rng.integers(60)), str(s) if (s := rng.integers(50)) else None, int(rng.integers(3)), "d" if rng.integers(2) else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, t long, incident long, signature string, region long, day string").repartition(7)
    whole = df.groupBy("region", "day").applyInPandas(keep_unseen, df.schema)
    small = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(small)
    spark.conf.set(small, "16")
    try:
        mine = incidents.unseen(df, ["region", "day"])
        assert mine.columns == df.columns and sorted(map(str, mine.collect())) == sorted(map(str, whole.collect()))
        pairs = incidents.first_of_pairs(df, ["region", "day"])
        assert pairs.count() == df.select("region", "day", "incident", "signature").distinct().count()
    finally:
        spark.conf.set(small, before)
    assert incidents.unseen(df.limit(0), ["region", "day"]).count() == 0
    rows = [(1, 1, None, None), (2, 1, None, None), (3, 2, None, "a"), (4, 3, None, "a"), (5, 3, 9, None), (6, 4, 9, None), (7, 5, 9, "b"), (8, 6, 10, "b")]
    nulls = spark.createDataFrame([(*r, 1) for r in rows], "id long, t long, incident long, signature string, region long")
    assert sorted(r.id for r in incidents.unseen(nulls, ["region"]).collect()) == [1, 2, 3, 5, 8]


def test_day_digest_holds_no_window_in_one_frame(spark, sf_dir):
    from tidewatch.plans import feed_queries

    plan = feed_queries.day_digest(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
