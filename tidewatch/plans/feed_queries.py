"""Feeds, registries, review and alert views, lineage upserts and quality metrics over the report-like tables.

``as_of`` is the newest timestamp of the table. Regions, registries and approvals are derived from keys by formulas that the SQL repeats.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import places, scoring, text
from tidewatch.operators import incidents, lake
from tidewatch.operators import places as place_joins
from tidewatch.plans.shared import shared_dir
from tidewatch.sources import feeds

# Fixed values of the synthetic rule tables.
TERMS = ["password", "token", "secret", "license", "copyright", "http"]
ROLL_UP = [("fault", ["err"]), ("commerce", ["purch", "sign"])]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events")


def _as_of(df: DataFrame):
    return df.agg(F.max("ts")).first()[0]


def _ago(e: DataFrame, interval: str):
    return F.lit(_as_of(e)) - F.expr(f"INTERVAL {interval}")


def incremental_pull(spark, sf):
    """What a backfill takes: reports after each even source's mark of a day and a half ago, the newest few of a source without mark."""
    e = _events(spark, sf)
    marks = e.where((F.col("ts") <= _ago(e, "12 HOURS")) & (F.col("user_id") % 2 == 0)).groupBy("user_id").agg(F.max("event_id").alias("last"))
    return feeds.pull(e, marks, "user_id", "event_id", "ts", _as_of(e)).select("user_id", "event_id")


def source_shards(spark, sf):
    """Sources dealt in turn to 20 shards."""
    return feeds.shards(_events(spark, sf), "user_id", 20, F.floor(F.col("user_id") / 16))


def thermal_times(spark, sf):
    """Feed dates and clock times such as 930 as timestamps, by hour; impossible ones as null."""
    e = _events(spark, sf)
    date, clock = F.date_format("ts", "yyyy-MM-dd"), (F.col("user_id") % 25 * 100 + F.col("event_id") % 60).cast("string")
    at = feeds.observed_at(date, clock)
    return e.groupBy(F.date_format(at, "yyyy-MM-dd HH:00").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def props_json(spark, sf):
    """Numbers in the JSON properties, by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, sf).groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k >= 50).alias("high"))


def source_weights(spark, sf):
    """Total registered weight of the sources named on a report, and the trust that they give, by type; unknown sources get the default tier."""
    e = _events(spark, sf).select("event_type", F.concat(F.lit("N_"), F.col("user_id") % 40, F.lit(",n_"), F.col("user_id") % 13).alias("sources"))
    lists = e.groupBy("event_type", "sources").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n_regionkey") == 0, "official").when(F.col("n_regionkey") == 1, "monitor").otherwise("other")
    reg = _table(spark, sf, "nation").select(F.concat(F.lit("n_"), "n_nationkey").alias("source"), (F.lit(0.3) + F.col("n_nationkey") % 7 / 10.0).alias("weight"), kind.alias("kind"))
    named = lists.withColumn("source", F.explode(F.split(F.lower("sources"), ","))).join(reg, "source", "left")
    of = lambda k: F.count_if(F.col("kind") == k)
    each = named.groupBy("event_type", "sources").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("weight", F.lit(0.4))).alias("w"), of("official").alias("o"), of("monitor").alias("m"))
    each = each.withColumn("trust", scoring.confidence(F.col("k"), F.round("w", 6), F.col("o"), F.col("m"), F.lit(False), F.lit(False)))
    return each.groupBy("event_type").agg(F.round(F.sum(F.col("w") * F.col("n")) / F.sum("n"), 4).alias("avg_weight"), F.sum(F.col("trust") * F.col("n")).cast("long").alias("trust"))


def category_rollup(spark, sf):
    """Categories of types by ordered substring rules, side by side, by region."""
    e = _events(spark, sf).select((F.col("user_id") % 8).alias("region"), text.first_match(F.col("event_type"), ROLL_UP, "other").alias("category"))
    names = [*(n for n, _ in ROLL_UP), "other"]
    return e.groupBy("region").pivot("category", names).agg(F.count(F.lit(1))).na.fill(0, names)


def severity_levels(spark, sf):
    """Level of every region by its errors of the last day, with the newest as evidence."""
    e = _events(spark, sf)
    hit = (F.col("event_type") == "error") & (F.col("ts") >= _ago(e, "24 HOURS"))
    g = e.groupBy((F.col("user_id") % 8).alias("region")).agg(F.count_if(hit).alias("n"), F.max(F.when(hit, F.struct("ts", "event_id"))).alias("m"))
    level = F.when(F.col("n") >= 10, "HIGH").when(F.col("n") >= 5, "MEDIUM").when(F.col("n") >= 1, "LOW").otherwise("NONE")
    return g.select("region", "n", level.alias("level"), F.col("m.event_id").cast("string").alias("evidence"))


def critical_reports(spark, sf):
    """Reports of the last 12 hours that score high enough for their source and were not sent yet."""
    e = _events(spark, sf)
    sent = e.where("event_id % 7 = 0").select("event_id")
    high = (F.col("value") >= 20) & ((F.col("user_id") % 3 == 0) | (F.col("value") >= 40))
    return e.where((F.col("ts") >= _ago(e, "12 HOURS")) & high).join(sent, "event_id", "left_anti").select("event_id", "value")


def review_queue(spark, sf):
    """The three newest reports of two states and middling trust of the last two days."""
    e = _events(spark, sf)
    due = e.where(F.col("event_type").isin("click", "view") & F.col("value").between(5, 80) & (F.col("ts") >= _ago(e, "48 HOURS")))
    return due.orderBy(F.desc("ts"), F.desc("event_id")).limit(3).select("event_id", "event_type", "value")


def approvals(spark, sf):
    """Customers with an approval that is valid on a day, for a resource or for all."""
    day = F.lit("1996-06-01").cast("timestamp_ntz")
    valid = (F.col("o_orderdate") <= day) & (day <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")) & F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    o = _table(spark, sf, "orders").where(valid)
    return _table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def term_filter(spark, sf):
    """Documents holding any of the terms in any case, by language."""
    return _table(spark, sf, "documents").where(text.contains_any(F.col("text"), TERMS)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def evidence_search(spark, sf):
    """The newest document of each source that holds a term without a word that takes it back."""
    d = _table(spark, sf, "documents").where(text.contains_any(F.col("text"), TERMS) & ~text.contains_any(F.col("text"), ["not", "kein"]))
    return d.groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def region_states(spark, sf):
    """State of every region by the newest statement among its last 30 reports; unknown without one, never clear."""
    last = place_joins.trail(_events(spark, sf).withColumn("region", F.col("user_id") % 8), "region", ["ts", "event_id"], 30)
    state = F.when(F.col("event_type") == "error", "ACTIVE").when(F.col("event_type") == "purchase", "CLEAR")
    g = last.withColumn("state", state).groupBy("region").agg(F.max(F.when(F.col("state").isNotNull(), F.struct("ts", "event_id", "state"))).alias("m"))
    return g.select("region", F.coalesce("m.state", F.lit("UNKNOWN")).alias("state"))


def trails(spark, sf):
    """The last 20 reports of every source in order, as one line."""
    last = place_joins.trail(_events(spark, sf), "user_id", ["ts", "event_id"])
    line = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("k"), F.col("event_id").cast("string").alias("id"))))
    return last.groupBy("user_id").agg(line.alias("l")).select("user_id", F.array_join("l.id", ",").alias("trail"))


def day_digest(spark, sf):
    """Reports of each region and day whose source and rounded value were on none kept before."""
    e = _events(spark, sf).select((F.col("user_id") % 8).alias("region"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("id"),
                                  F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("incident"), F.floor("value").cast("string").alias("signature"))
    return incidents.unseen(e, ["region", "day"]).select("region", "day", "id")


def plausibility(spark, sf):
    """Implausibility of reports: outside the bounds, within a burst, or with a suspect property; suspects by type."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-10_800_000_000, 0)
    e = _events(spark, sf).withColumn("burst", F.count(F.lit(1)).over(w) >= 5).withColumn("lat", F.lit(44.0) + F.col("user_id") * 7919 % 850 / 100.0)
    points = lambda test, x: F.when(test, x).otherwise(0)
    score = F.least(F.lit(100), points(~F.col("lat").between(44.5, 52.0), 50) + points(F.col("burst"), 50) + points(F.contains("props", F.lit("7")), 35))
    return e.withColumn("score", score).groupBy("event_type").agg(F.count_if(F.col("score") >= 60).alias("suspects"), F.sum("score").alias("total"))


def precision_classes(spark, sf):
    """Count and mean radius by class with the mean of all, weighted by the rounded class means; hit rates are null without rows."""
    g = _events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 1).alias("radius"), F.count_if(F.col("user_id") % 5 == 0).alias("hits"))
    all_ = Window.partitionBy()  # one row per class
    mean = F.try_divide(F.sum(F.col("radius") * F.col("n")).over(all_), F.sum("n").over(all_))
    return g.select("event_type", "n", "radius", F.round(mean, 3).alias("mean_radius"), F.round(F.try_divide(F.col("hits") * 100.0, F.col("n")), 2).alias("hit_rate"))


def edge_upsert(spark, sf):
    """Forward edges: counts, first and last report and the newest sample, without edges to oneself."""
    e = _events(spark, sf).select("event_id", "props", F.col("user_id").alias("source"), ((F.col("user_id") * 3 + F.col("event_id")) % 50).alias("target")).where("source <> target")
    sample = F.max_by(F.substring("props", 1, 500), "event_id").alias("sample")
    return e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), sample)


def context_lines(spark, sf):
    """The ten newest reports of each region within 12 hours as one text."""
    e = _events(spark, sf)
    last = place_joins.trail(e.where(F.col("ts") >= _ago(e, "12 HOURS")).withColumn("region", F.col("user_id") % 8), "region", ["ts", "event_id"], 10)
    rows = F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" ", F.date_format("ts", "HH:mm"), "event_type", "event_id").alias("s"))))
    return last.groupBy("region").agg(rows.alias("l")).select("region", F.array_join("l.s", "; ").alias("context"))


def threshold_sweep(spark, sf):
    """F1 of every threshold on the value against errors, and whether it is the lowest of the best."""
    e = _events(spark, sf).groupBy(F.floor("value").alias("v"), (F.col("event_type") == "error").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    t = e.withColumn("threshold", F.explode(F.sequence(F.lit(10), F.lit(80), F.lit(5))))
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    says = F.col("v") >= F.col("threshold")
    g = t.groupBy("threshold").agg(n(says & F.col("y")).alias("tp"), n(says & ~F.col("y")).alias("fp"), n(~says & F.col("y")).alias("fn"))
    g = g.withColumn("f1", F.round(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), 4))
    return g.withColumn("best", F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last("f1"), "threshold")) == 1)


def lake_files(spark, sf):
    """Files, rows and rows per file of a lake that two overlapping batches were archived in, day by day."""
    e, path = _events(spark, sf), f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}"
    lake.archive(spark, e.where("event_id % 2 = 0"), path, "event_id", "ts")
    lake.archive(spark, e.where("event_id % 3 > 0"), path, "event_id", "ts")
    files = lake.lake_stats(spark.read.parquet(path))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("n"), F.round(F.avg("rows"), 1).alias("per_file"))


def perimeters(spark, sf):
    """Three public-safety zones by type and value."""
    names = ("inner_m", "middle_m", "outer_m")
    zones = [z.alias(n) for z, n in zip(scoring.safety_zones_m(F.col("event_type") == "error", F.col("value")), names, strict=True)]
    return _events(spark, sf).groupBy("event_type", *zones).agg(F.count(F.lit(1)).alias("n"))


def admiralty(spark, sf):
    """Reliability of the source and credibility of the report, by the registry's tier and the media."""
    tier = F.col("user_id") % 4
    rel = F.when(tier == 0, "A").when(tier == 1, "B").when(tier == 2, "C").otherwise("D")
    cred = F.when((tier == 0) | (F.col("event_type") == "view"), 1).when(tier == 1, 2).otherwise(3)
    return _events(spark, sf).groupBy(rel.alias("reliability"), cred.alias("credibility")).agg(F.count(F.lit(1)).alias("n"))


def sun_heights(spark, sf):
    """Elevation of the sun and shadow length at the place and time of every error."""
    e = _events(spark, sf).where("event_type = 'error'")
    up, shadow, way = places.sun(F.lit(44.0) + F.col("user_id") % 850 / 100.0, F.lit(22.0) + F.col("user_id") * 7 % 1800 / 100.0, F.col("ts"))
    return e.select("event_id", F.round(up, 3).alias("elevation"), F.when(up > 1, F.round(shadow, 2)).alias("shadow"), F.when(F.abs(up) < 80, F.round(way, 2)).alias("azimuth"))


QUERIES = {f.__name__: f for f in (
    incremental_pull, source_shards, thermal_times, props_json, source_weights, category_rollup, severity_levels, critical_reports, review_queue, approvals, term_filter,
    evidence_search, region_states, trails, day_digest, plausibility, precision_classes, edge_upsert, context_lines, threshold_sweep, lake_files, perimeters, admiralty, sun_heights,
)}

_NOW = "(SELECT max(ts) FROM events)"
_TERMS = "|".join(TERMS)
_NEWEST = "SELECT *, user_id % 8 AS region, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts DESC, event_id DESC) AS place FROM events"

ORACLE = {
    "day_digest": "WITH RECURSIVE e AS (SELECT user_id % 8 AS region, strftime(ts, '%Y-%m-%d') AS day, event_id AS id, user_id AS incident, floor(value)::BIGINT::VARCHAR AS signature, row_number() OVER (PARTITION BY user_id % 8, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS k FROM events), f AS (SELECT DISTINCT region, day, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS seen, CAST([] AS VARCHAR[]) AS signed, CAST(NULL AS BIGINT) AS id FROM e UNION ALL SELECT region, day, k, CASE WHEN new THEN list_append(seen, incident) ELSE seen END, CASE WHEN new AND signature IS NOT NULL THEN list_append(signed, signature) ELSE signed END, CASE WHEN new THEN id END FROM (SELECT e.*, f.seen, f.signed, NOT list_contains(f.seen, e.incident) AND (e.signature IS NULL OR NOT list_contains(f.signed, e.signature)) AS new FROM f JOIN e ON e.region = f.region AND e.day = f.day AND e.k = f.k + 1)) SELECT region, day, id FROM f WHERE id IS NOT NULL",
    "incremental_pull": f"WITH m AS (SELECT user_id, max(event_id) AS last FROM events WHERE ts <= {_NOW} - INTERVAL 12 HOUR AND user_id % 2 = 0 GROUP BY 1), f AS (SELECT user_id, event_id, last, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events LEFT JOIN m USING (user_id) WHERE ts >= {_NOW} - INTERVAL 24 HOUR AND (last IS NULL OR event_id > last)) SELECT user_id, event_id FROM f WHERE k <= CASE WHEN last IS NULL THEN 5 ELSE 20 END",
    "source_shards": "SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 20 AS shard FROM (SELECT DISTINCT user_id FROM events)",
    "thermal_times": "SELECT CASE WHEN user_id % 25 < 24 THEN strftime(ts, '%Y-%m-%d') || ' ' || lpad((user_id % 25)::VARCHAR, 2, '0') || ':00' END AS hour, count(*) AS n FROM events GROUP BY 1",
    "props_json": r"SELECT event_type, sum(k)::BIGINT AS total, count(*) FILTER (k >= 50) AS high FROM (SELECT event_type, regexp_extract(props, '\"k\": ([0-9]+)', 1)::BIGINT AS k FROM events) GROUP BY 1".replace('\\"', '"'),
    "source_weights": "WITH r AS (SELECT 'n_' || n_nationkey AS source, 0.3::DOUBLE + (n_nationkey % 7) / 10.0::DOUBLE AS weight, n_regionkey AS g FROM nation), e AS (SELECT event_id, event_type, unnest(string_split(lower('N_' || (user_id % 40) || ',n_' || (user_id % 13)), ',')) AS source FROM events), b AS (SELECT event_id, event_type, sum(coalesce(weight, 0.4::DOUBLE)) AS w, count(*) FILTER (g = 0) AS o, count(*) FILTER (g = 1) AS m FROM e LEFT JOIN r USING (source) GROUP BY 1, 2), t AS (SELECT event_type, w, CASE WHEN o >= 1 AND round(w, 6) >= 2.0 THEN 95 WHEN o >= 1 THEN 90 WHEN round(w, 6) >= 1.5 THEN 85 WHEN round(w, 6) >= 1.2 THEN 70 WHEN m >= 1 THEN 60 ELSE 40 END AS trust FROM b) SELECT event_type, round(avg(w), 4) AS avg_weight, sum(trust)::BIGINT AS trust FROM t GROUP BY 1",
    "category_rollup": "SELECT user_id % 8 AS region, count(*) FILTER (event_type LIKE '%err%') AS fault, count(*) FILTER (event_type NOT LIKE '%err%' AND (event_type LIKE '%purch%' OR event_type LIKE '%sign%')) AS commerce, count(*) FILTER (NOT regexp_matches(event_type, 'err|purch|sign')) AS other FROM events GROUP BY 1",
    "severity_levels": f"WITH e AS (SELECT user_id % 8 AS region, event_id, ts, event_type = 'error' AND ts >= {_NOW} - INTERVAL 24 HOUR AS hit FROM events) SELECT region, count(*) FILTER (hit) AS n, CASE WHEN count(*) FILTER (hit) >= 10 THEN 'HIGH' WHEN count(*) FILTER (hit) >= 5 THEN 'MEDIUM' WHEN count(*) FILTER (hit) >= 1 THEN 'LOW' ELSE 'NONE' END AS level, arg_max(event_id, ts) FILTER (hit)::VARCHAR AS evidence FROM e GROUP BY 1",
    "critical_reports": f"SELECT event_id, value FROM events WHERE ts >= {_NOW} - INTERVAL 12 HOUR AND value >= 20 AND (user_id % 3 = 0 OR value >= 40) AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 7 = 0)",
    "review_queue": f"SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 5 AND 80 AND ts >= {_NOW} - INTERVAL 48 HOUR ORDER BY ts DESC, event_id DESC LIMIT 3",
    "approvals": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND TIMESTAMP '1996-06-01' <= o_orderdate + INTERVAL 60 DAY AND o_orderpriority IN ('1-URGENT', '5-LOW'))",
    "term_filter": f"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '{_TERMS}') GROUP BY 1",
    "evidence_search": f"SELECT source, max(doc_id) AS doc_id, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '{_TERMS}') AND NOT regexp_matches(lower(text), 'not|kein') GROUP BY 1",
    "region_states": f"WITH l AS ({_NEWEST}), s AS (SELECT region, place, CASE event_type WHEN 'error' THEN 'ACTIVE' WHEN 'purchase' THEN 'CLEAR' END AS state FROM l WHERE place <= 30) SELECT region, coalesce(arg_min(state, place) FILTER (state IS NOT NULL), 'UNKNOWN') AS state FROM s GROUP BY 1",
    "trails": "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY place DESC) AS trail FROM l WHERE place <= 20 GROUP BY 1",
    "plausibility": "WITH e AS (SELECT event_type, props, 44.0::DOUBLE + (user_id * 7919 % 850) / 100.0::DOUBLE AS lat, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) >= 5 AS burst FROM events), s AS (SELECT event_type, least(100, CASE WHEN lat BETWEEN 44.5 AND 52.0 THEN 0 ELSE 50 END + CASE WHEN burst THEN 50 ELSE 0 END + CASE WHEN contains(props, '7') THEN 35 ELSE 0 END) AS score FROM e) SELECT event_type, count(*) FILTER (score >= 60) AS suspects, sum(score)::BIGINT AS total FROM s GROUP BY 1",
    "precision_classes": "WITH g AS (SELECT event_type, count(*) AS n, round(avg(value), 1) AS radius, count(*) FILTER (user_id % 5 = 0) AS hits FROM events GROUP BY 1) SELECT event_type, n, radius, round(sum(radius * n) OVER () / sum(n) OVER (), 3) AS mean_radius, round(hits * 100.0::DOUBLE / n, 2) AS hit_rate FROM g",
    "edge_upsert": "SELECT source, target, count(*) AS weight, min(event_id) AS first_id, max(event_id) AS last_id, arg_max(substr(props, 1, 500), event_id) AS sample FROM (SELECT event_id, props, user_id AS source, (user_id * 3 + event_id) % 50 AS target FROM events) WHERE source <> target GROUP BY 1, 2",
    "context_lines": f"WITH l AS ({_NEWEST}) SELECT region, string_agg(strftime(ts, '%H:%M') || ' ' || event_type || ' ' || event_id, '; ' ORDER BY place) AS context FROM l WHERE place <= 10 AND ts >= {_NOW} - INTERVAL 12 HOUR GROUP BY 1",
    "threshold_sweep": "WITH t AS (SELECT value, event_type = 'error' AS y, unnest(generate_series(10, 80, 5))::INTEGER AS threshold FROM events), g AS (SELECT threshold, count(*) FILTER (value >= threshold AND y) AS tp, count(*) FILTER (value >= threshold AND NOT y) AS fp, count(*) FILTER (value < threshold AND y) AS fn FROM t GROUP BY 1), f AS (SELECT *, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM g) SELECT *, row_number() OVER (ORDER BY f1 DESC NULLS LAST, threshold) = 1 AS best FROM f",
    "lake_files": "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_id % 2 = 0 OR event_id % 3 > 0 GROUP BY 1) SELECT count(*) AS files, sum(n)::BIGINT AS n, round(avg(n), 1) AS per_file FROM d",
    "perimeters": "SELECT event_type, CASE WHEN w THEN 60 ELSE 30 END::INTEGER AS inner_m, CASE WHEN w THEN 180 ELSE 90 END::INTEGER AS middle_m, CASE WHEN w THEN 450 ELSE 200 END::INTEGER AS outer_m, count(*) AS n FROM (SELECT event_type, event_type = 'error' OR value >= 80 AS w FROM events) GROUP BY ALL",
    "admiralty": "SELECT CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS reliability, CASE WHEN user_id % 4 = 0 OR event_type = 'view' THEN 1 WHEN user_id % 4 = 1 THEN 2 ELSE 3 END::INTEGER AS credibility, count(*) AS n FROM events GROUP BY 1, 2",
    "sun_heights": "WITH e AS (SELECT event_id, radians(44.0::DOUBLE + (user_id % 850) / 100.0::DOUBLE) AS lat, 22.0::DOUBLE + (user_id * 7 % 1800) / 100.0::DOUBLE AS lon, hour(ts) + minute(ts) / 60.0::DOUBLE + floor(second(ts)) / 3600.0::DOUBLE AS h, dayofyear(ts) AS d FROM events WHERE event_type = 'error'), g AS (SELECT *, 2 * pi() / 365 * (d - 1 + (h - 12) / 24) AS g FROM e), s AS (SELECT *, 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) AS eq, 0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS tilt FROM g), t AS (SELECT *, radians((h * 60 + eq + 4 * lon) / 4 - 180) AS turn FROM s), u AS (SELECT event_id, degrees(atan2(-cos(tilt) * sin(turn), cos(lat) * sin(tilt) - sin(lat) * cos(tilt) * cos(turn))) AS way, degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(lat) * sin(tilt) + cos(lat) * cos(tilt) * cos(turn))))) AS up FROM t) SELECT event_id, round(up, 3) AS elevation, CASE WHEN up > 1 THEN round(1 / tan(radians(up)), 2) END AS shadow, CASE WHEN abs(up) < 80 THEN round(way + CASE WHEN way < 0 THEN 360 ELSE 0 END, 2) END AS azimuth FROM u",
}
