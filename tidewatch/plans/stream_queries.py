"""Streams over the events' files, run over all that is there, and their batch results as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.shared import shared_dir
from tidewatch.streaming import reports


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream, by a pattern that fits one file or a folder of them; read with the time type that they have."""
    kind = dict(spark.read.parquet(f"{sf}/events.parquet").dtypes)["ts"]
    rows = reports.read_reports(spark, f"{sf}/event[s].parquet", schema=reports.SCHEMA.replace("ts timestamp", f"ts {kind}"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    at = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    return reports.run_available(df, f"{at}/out", f"{at}/checkpoint", mode)


def stream_hours(spark, sf):
    """Tumbling hours by type, as a stream in complete mode."""
    out = _run(reports.tumbling(_stream(spark, sf)), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def stream_sliding(spark, sf):
    """Hours that begin every half hour, by type, as a stream in complete mode."""
    out = _run(reports.tumbling(_stream(spark, sf), "1 hour", "30 minutes"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def stream_once(spark, sf):
    """Each of (source, type, minute) once, as a stream: what a sink gets from repeated deliveries."""
    twice = _stream(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2))))
    out = _run(reports.without_duplicates(twice))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _sensors(e: DataFrame) -> DataFrame:
    """Errors and the clicks of the five minutes before within 22 km, of a table or a stream of events."""
    k = F.col("user_id")
    e = e.withColumns({"lat": F.lit(44.0) + k * 7919 % 50 / 100.0, "lon": F.lit(22.0) + k * 104729 % 50 / 100.0})
    left = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "ts", "lat", "lon")
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("hit"), F.col("ts").alias("heard_at"), F.col("lat").alias("hit_lat"), F.col("lon").alias("hit_lon"))
    return reports.near_sensors(left, right)


def sensor_pairs(spark, sf):
    """Errors and the clicks of the five minutes before within 22 km."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return _sensors(e).select("id", "hit", F.round("km", 3).alias("km"))


def stream_sensor_pairs(spark, sf):
    """The same pairs as a join of two watermarked streams."""
    return _run(_sensors(_stream(spark, sf))).select("id", "hit", F.round("km", 3).alias("km"))


QUERIES = {f.__name__: f for f in (stream_hours, stream_sliding, stream_once, sensor_pairs, stream_sensor_pairs)}

_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"

ORACLE = {
    "stream_hours": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - s * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(s) GROUP BY 1, 2",
    "stream_once": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
    "sensor_pairs": f"WITH e AS (SELECT event_id, event_type, ts, 44.0::DOUBLE + (user_id * 7919 % 50) / 100.0::DOUBLE AS lat, 22.0::DOUBLE + (user_id * 104729 % 50) / 100.0::DOUBLE AS lon FROM events) SELECT a.event_id AS id, b.event_id AS hit, round({_KM}, 3) AS km FROM e a JOIN e b ON a.event_type = 'error' AND b.event_type = 'click' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 300 SECOND WHERE {_KM} <= 22",
}
ORACLE["stream_sensor_pairs"] = ORACLE["sensor_pairs"]
