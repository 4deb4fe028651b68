"""Subscribers are told once, streams in minutes give the batch order, sensor joins let state go, and progress shows what stands still."""

import datetime
import random
import time

from pyspark.sql import functions as F

from tidewatch.streaming import ordered, progress, reports

BEGIN = datetime.datetime(2024, 1, 1)
ALERTS, SUBS = "region long, id long, ts timestamp, says string", "region long, id long, ts timestamp, subscriber string"


def files(spark, rows, schema, path, n):
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_subscribers_are_told_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd, rows = random.Random(1), []
    for i in range(240):
        at = BEGIN + datetime.timedelta(seconds=i * 40)
        rows.append((i, rnd.randrange(2), at, rnd.choice(["ACTIVE", "CLEAR", "UNKNOWN", None, "sub", "sub"])))
    alerts = [(r, i, t, s) for i, r, t, s in rows if s != "sub"]
    subs = [(r, i, t, f"u{i % 5}") for i, r, t, s in rows if s == "sub"]
    want, state, held = [], {}, {}
    for i, r, _, s in rows:
        if s == "sub":
            held.setdefault(r, set()).add(f"u{i % 5}")
        elif s in ("ACTIVE", "CLEAR"):
            if state.get(r) == "ACTIVE" and s == "CLEAR":
                want += [(r, i, u) for u in sorted(held.pop(r, ()))]
            state[r] = s
    end = [(r, 10_000 + r, BEGIN + datetime.timedelta(days=2), None) for r in (0, 1)]
    again = [x for x in alerts if rnd.random() < 0.3]  # delivered twice, in the same file
    a = files(spark, sorted(alerts + again, key=lambda x: x[2]) + end, ALERTS, f"{tmp_path}/a", 3)
    s = files(spark, subs + [(r, i + 10, t, None) for r, i, t, _ in end], SUBS, f"{tmp_path}/s", 3)
    # Both sides share one watermark, so rows of the slower one may be late by as much as a file.
    out = reports.run_available(ordered.alert_subscriptions(a, s, late="6 hours"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 10


def test_sensor_state_is_let_go(spark, tmp_path):
    """The join of two streams gives the table's pairs and holds a part of the rows at its end."""
    rnd = random.Random(2)
    rows = [(i, BEGIN + datetime.timedelta(seconds=i * 30), 80 + rnd.random(), rnd.choice([179.9, -179.9, 179.5])) for i in range(400)]
    left, right = "id long, ts timestamp, lat double, lon double", "hit long, heard_at timestamp, hit_lat double, hit_lon double"
    a, b = files(spark, rows[::2], left, f"{tmp_path}/a", 4), files(spark, rows[1::2], right, f"{tmp_path}/b", 4)
    query = reports.near_sensors(a, b, late="1 minute").writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    whole = reports.near_sensors(spark.createDataFrame(rows[::2], left), spark.createDataFrame(rows[1::2], right))
    got = sorted((r.id, r.hit) for r in spark.table("pairs").collect())
    assert got == sorted((r.id, r.hit) for r in whole.collect()) and len(got) > 100
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert state[-1] < max(state) < 200 + 200 * 9 * 2


def test_progress_table(spark, tmp_path):
    table = progress.ProgressTable(spark, f"{tmp_path}/progress", every=2)
    spark.streams.addListener(table)
    try:
        rows = [(0, i, BEGIN + datetime.timedelta(minutes=i), "ACTIVE") for i in range(30)]
        stream = files(spark, rows, ALERTS, f"{tmp_path}/a", 3).withWatermark("ts", "1 minute").dropDuplicatesWithinWatermark(["id"])
        query = stream.writeStream.format("noop").queryName("once").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            time.sleep(0.2)
            if table.pending == [] and spark._jvm.java.io.File(f"{tmp_path}/progress").exists() and spark.read.parquet(f"{tmp_path}/progress").where("ended").count():
                break
    finally:
        spark.streams.removeListener(table)
    seen = spark.read.schema(progress.SCHEMA).parquet(f"{tmp_path}/progress")
    assert seen.where("not ended").agg(F.sum("rows")).first()[0] == 30
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    running = {r.query: r for r in progress.health(seen.where("not ended"), now).collect()}
    assert running["once"].status == "RUNNING" and running["once"].state_rows is not None and running["once"].lag_s > 0
    assert progress.health(seen.where("not ended"), now + datetime.timedelta(hours=1)).first().status == "STALLED"
    assert {(r.query, r.status) for r in progress.health(seen, now).collect()} == {("once", "ENDED")}
    failed = spark.createDataFrame([("q", None, None, None, None, None, None, None, None, None, None, True, "boom")], progress.SCHEMA)
    assert progress.health(failed, now).first().status == "FAILED"
