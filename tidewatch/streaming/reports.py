"""Streams of reports: file source, duplicates, windows, sensor pairs, merges into a table, and triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.geo import haversine_km
from tidewatch.operators.spatial import _cells

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_reports(spark: SparkSession, path: str, files_at_once: int = 4, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def parse_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Reports from JSON messages; what cannot be parsed keeps its text and a reason.

    A fenced message is freed of its fence, trailing commas are dropped, and numbers in quotation marks are read as numbers.
    """
    text = F.regexp_replace(F.trim(F.col(column).cast("string")), r"^```(?:json)?\s*|\s*```$", "")
    text = F.regexp_replace(text, r",\s*([}\]])", "$1")
    loose = F.from_json(text, "event_id string, ts string, user_id string, event_type string, value string, props string")
    parsed = raw.withColumn("_r", loose)
    typed = [F.col(f"_r.{c}").try_cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))]
    return parsed.select(*typed, F.when(F.col("_r.event_id").try_cast("long").isNull(), "invalid_json").alias("skip_reason"), F.col(column).cast("string").alias("raw"))


def without_duplicates(reports: DataFrame, late: str = "24 hours", keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Each key once within the watermark: at-least-once delivery becomes exactly once for the sink behind it."""
    return reports.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(reports: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "24 hours") -> DataFrame:
    """Counts by window and type; with ``slide`` the windows overlap."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return reports.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def near_sensors(reports: DataFrame, hits: DataFrame, km: float = 22.0, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(id, hit, km) of reports (id, ts, lat, lon) and sensor hits (hit, heard_at, hit_lat, hit_lon) at most ``km`` apart, the hit at most ``seconds`` older.

    Over streams as over tables. Rows meet by cell, in both directions and over the whole globe, and by span of clock time, so that a key holds no more than the
    rows of one neighbourhood and two spans; watermarks of both sides and the interval let the state go.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    left = _cells(reports.withWatermark("ts", late).select("id", "ts", "lat", "lon"), km, False).withColumn("_slot", slot("ts"))
    right = hits.withWatermark("heard_at", late).select("hit", "heard_at", F.col("hit_lat").alias("lat"), F.col("hit_lon").alias("lon"))
    right = _cells(right, km, True).withColumn("hit_slot", F.explode(F.array(slot("heard_at"), slot("heard_at") + 1)))
    right = right.withColumnsRenamed({"lat": "hit_lat", "lon": "hit_lon", "_cell": "hit_cell"})
    near = (F.col("heard_at") <= F.col("ts")) & (F.col("heard_at") >= F.col("ts") - F.expr(f"INTERVAL {seconds} SECONDS"))
    pairs = left.join(right, (F.col("_cell") == F.col("hit_cell")) & (F.col("_slot") == F.col("hit_slot")) & near)
    return pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("hit_lat"), F.col("hit_lon"))).where(F.col("km") <= km).select("id", "hit", "km")


def publish(reports: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("event_id",), late: str = "24 hours", every: str | None = None):
    """A durable log of reports, each key once: files under ``path``; runs over what is there, or goes on ``every`` so often."""
    out = without_duplicates(reports, late, keys).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return _started(out, every)


def merge_into(reports: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hands every micro-batch to ``merge(batch, number)``, which must give the same for a number that comes again."""
    return _started(reports.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), every)


def _started(writer, every: str | None):
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there; returns what it has written to ``path``, the last state of it in complete mode."""
    spark = df.sparkSession
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", path)
    else:
        writer = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    _started(writer.option("checkpointLocation", checkpoint).outputMode(mode), None)
    return spark.read.schema(df.schema).parquet(path)
