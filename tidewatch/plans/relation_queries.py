"""Spatial joins, forward graph, consensus and vector similarity over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.operators import hashes, merge, spatial


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _place(key: str):
    k = F.col(key)
    return (F.lit(44.0) + k * 7919 % 850 / 100.0).alias("lat"), (F.lit(22.0) + k * 104729 % 1800 / 100.0).alias("lon")


def _customers(spark, sf):
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *_place("c_custkey"))


def _suppliers(spark, sf):
    return _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("other_id"), *_place("s_suppkey"))


def nearest_shelters(spark, sf):
    """Three nearest suppliers of every customer."""
    near = spatial.nearest(_customers(spark, sf), _suppliers(spark, sf), 3, 60.0)
    return near.select("id", F.col("place").cast("long").alias("place"), "other_id", F.round("km", 3).alias("km"))


def radius_join(spark, sf):
    """Suppliers within 50 km of every customer."""
    return spatial.within_km(_customers(spark, sf), _suppliers(spark, sf), 50.0, 3).select("id", "other_id", "km")


def space_time_nearest(spark, sf):
    """For every error the nearest purchase within 60 km and 8 hours."""
    e = _read(spark, sf, "events").select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), *_place("user_id"))
    right = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "other_id")
    return spatial.nearest_in_time(e.where("event_type = 'error'").withColumnRenamed("event_id", "id"), right, 60.0, 28_800)


def bearings(spark, sf):
    """Distance and bearing from the first supplier to every customer, with the compass octant and box membership."""
    c = _customers(spark, sf)
    lat, lon = F.lit(48.0), F.lit(31.0)
    b = geo.bearing(lat, lon, F.col("lat"), F.col("lon"))
    inside = geo.in_box(F.col("lat"), F.col("lon"), 46.0, 28.0, 50.0, 34.0) & ~geo.in_box(F.col("lat"), F.col("lon"), 47.0, 30.0, 49.0, 32.0)
    g = c.select(F.floor(b / 45).alias("octant"), geo.haversine_km(lat, lon, F.col("lat"), F.col("lon")).alias("km"), inside.alias("inside"))
    return g.groupBy("octant", "inside").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("km"), 2).alias("avg_km"))


def _edges(spark, sf):
    o, li = _read(spark, sf, "orders"), _read(spark, sf, "lineitem")
    e = o.select("o_orderkey", F.col("o_custkey").alias("source")).join(li.select("l_orderkey", F.col("l_suppkey").alias("target")), F.col("o_orderkey") == F.col("l_orderkey"))
    return e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def graph_degrees(spark, sf):
    """Degrees over the 200 heaviest edges."""
    top = _edges(spark, sf).orderBy(F.desc("weight"), "source", "target").limit(200)
    ends = top.select(F.concat(F.lit("c"), F.col("source")).alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), "weight").unionByName(
        top.select(F.concat(F.lit("s"), F.col("target")).alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"), "weight")
    )
    return ends.groupBy("node").agg(F.sum("out").alias("out_degree"), F.sum("into").alias("in_degree"), F.sum("weight").alias("weight"))


def top_forwarders(spark, sf):
    """Sources by their total weight, with how many targets they reach."""
    g = _edges(spark, sf).groupBy("source").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("targets"))
    return g.orderBy(F.desc("total"), "source").limit(20)


def lineage(spark, sf):
    """Edges into and out of one node."""
    e = _edges(spark, sf)
    out = e.where("source = 7").select(F.lit("out").alias("way"), F.col("target").alias("other"), "weight")
    return out.unionByName(e.where("target = 7").select(F.lit("in").alias("way"), F.col("source").alias("other"), "weight"))


def _evidence(spark, sf):
    """Suppliers as evidence of where their nation is: three tight groups and one spread."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    apart = F.when(n % 4 == 0, 0.2).otherwise(0.002)
    return _read(spark, sf, "supplier").select(
        n.alias("nation"), k.alias("source"), (F.lit(48.0) + n * 0.1 + apart * (k % 7)).alias("lat"), (F.lit(30.0) + n * 0.1 + apart * (k % 5)).alias("lon"),
        (F.lit(0.2) + k % 8 / 10.0).alias("confidence"), (F.lit(100.0) + k % 9 * 100).alias("radius_m"), (k % 6 + 1).cast("int").alias("reliability"), (k % 5 + 1).cast("int").alias("credibility"),
    )


def consensus(spark, sf):
    """One position of each nation: the weighted centre, or the most trusted evidence where it diverges."""
    return merge.agreed(_evidence(spark, sf), "nation").select("nation", "source", "lat", "lon", "confidence", "radius_m", "conflict")


def fused_centres(spark, sf):
    """Centre of each nation's facts, weighted by confidence over squared spread, with radius, conflicts and grade."""
    return merge.fused(_evidence(spark, sf).withColumnRenamed("radius_m", "spread_m"), "nation")


LOOKBACK, ALIKE = 500, 0.35


def _ranked(v: DataFrame) -> DataFrame:
    """``v`` with ``rank``, its place by vec_id: ranges of ids are numbered apart and moved by the counts of those before."""
    n = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(x) for x in v.approxQuantile("vec_id", [i / n for i in range(1, n)], min(0.01, 1 / (8 * n)))}) if n > 1 else []
    ranged = v.withColumn("_range", F.size(F.filter(F.lit(bounds), lambda x: x <= F.col("vec_id"))) if bounds else F.lit(0))
    sizes = dict(ranged.groupBy("_range").count().collect())  # a row per range
    starts = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(bounds) + 1)]
    place = F.row_number().over(Window.partitionBy("_range").orderBy("vec_id", "label", "e"))
    return ranged.withColumn("rank", F.element_at(F.lit(starts).cast("array<long>"), F.col("_range") + 1) + place).drop("_range")


def similar_images(spark, sf):
    """For every vector the newest one before it, of its label and among the ``LOOKBACK`` before it, whose cosine is ``ALIKE`` at least."""
    v = _read(spark, sf, "embeddings").where("vec_id IS NOT NULL").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = _ranked(v).withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e"))))
    block = F.floor(F.col("rank") / LOOKBACK)
    o = v.select(F.col("vec_id").alias("other_id"), "label", F.col("e").alias("f"), F.col("norm").alias("other_norm"), F.col("rank").alias("other_rank"), block.alias("block"))
    p = v.withColumn("block", F.explode(F.array(block, block - 1))).join(o, ["label", "block"])
    p = p.where((F.col("other_rank") < F.col("rank")) & (F.col("other_rank") >= F.col("rank") - LOOKBACK) & (F.col("other_id") < F.col("vec_id")))
    p = p.withColumn("cosine", F.round(dot(F.col("e"), F.col("f")) / (F.col("norm") * F.col("other_norm")), 6))
    best = p.where(F.col("cosine") >= ALIKE).groupBy("vec_id").agg(F.max(F.struct("other_id", "cosine")).alias("m"))
    return best.select("vec_id", F.col("m.other_id").alias("other_id"), F.col("m.cosine").alias("cosine"))


def similar_hashes(spark, sf):
    """For every document the newest of the ``LOOKBACK`` before it, thirty days old at most, whose hash of 64 bits (four from each sixteenth of the text) differs in at most 5, with the score of the match."""
    k, n = F.col("doc_id"), F.length("text")
    edge = lambda i: F.floor(n * i / 16).cast("int")
    digits = F.concat(*(F.substring(F.md5(F.substring(F.col("text"), edge(i) + 1, edge(i + 1) - edge(i)).cast("binary")), 1, 1) for i in range(16)))
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    hours = k + F.floor(k / 300) * 500
    rows = _read(spark, sf, "documents").select(k.alias("id"), (hours * 3600).alias("t"), F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("hash"))
    return hashes.newest_like(rows, LOOKBACK).select(F.col("id").alias("doc_id"), "other_id", hashes.score(F.col("bits")).alias("score"))


QUERIES = {f.__name__: f for f in (nearest_shelters, radius_join, space_time_nearest, bearings, graph_degrees, top_forwarders, lineage, consensus, fused_centres, similar_images, similar_hashes)}

_LAT, _LON = "44.0::DOUBLE + ({0} * 7919 % 850) / 100.0::DOUBLE", "22.0::DOUBLE + ({0} * 104729 % 1800) / 100.0::DOUBLE"
_C = f"c AS (SELECT c_custkey AS id, {_LAT.format('c_custkey')} AS lat, {_LON.format('c_custkey')} AS lon FROM customer)"
_S = f"s AS (SELECT s_suppkey AS other_id, {_LAT.format('s_suppkey')} AS lat2, {_LON.format('s_suppkey')} AS lon2 FROM supplier)"
_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_PAIR = _KM.format("lat", "lon", "lat2", "lon2")
_EVIDENCE = "e AS (SELECT s_nationkey AS nation, s_suppkey AS source, 48.0::DOUBLE + s_nationkey * 0.1::DOUBLE + CASE WHEN s_nationkey % 4 = 0 THEN 0.2::DOUBLE ELSE 0.002::DOUBLE END * (s_suppkey % 7) AS lat, 30.0::DOUBLE + s_nationkey * 0.1::DOUBLE + CASE WHEN s_nationkey % 4 = 0 THEN 0.2::DOUBLE ELSE 0.002::DOUBLE END * (s_suppkey % 5) AS lon, 0.2::DOUBLE + (s_suppkey % 8) / 10.0::DOUBLE AS confidence, 100.0::DOUBLE + s_suppkey % 9 * 100 AS radius_m, s_suppkey % 6 + 1 AS reliability, s_suppkey % 5 + 1 AS credibility, confidence * 1000 / greatest(radius_m, 10.0) AS w FROM supplier)"
_EDGES = "e AS (SELECT o_custkey AS source, l_suppkey AS target, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"

ORACLE = {
    "nearest_shelters": f"WITH {_C}, {_S}, p AS (SELECT id, other_id, {_PAIR} AS km FROM c, s) SELECT id, place, other_id, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, other_id) AS place FROM p) WHERE place <= 3",
    "radius_join": f"WITH {_C}, {_S} SELECT id, other_id, round({_PAIR}, 3) AS km FROM c, s WHERE {_PAIR} <= 50",
    "space_time_nearest": f"WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t, {_LAT.format('user_id')} AS lat, {_LON.format('user_id')} AS lon FROM events), p AS (SELECT a.event_id AS id, b.event_id AS other_id, round({_KM.format('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS km FROM e a JOIN e b ON a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.t - b.t) <= 28800000000) SELECT id, other_id, km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, other_id) AS k FROM p WHERE km <= 60) WHERE k = 1",
    "bearings": f"WITH {_C}, b AS (SELECT lat, lon, degrees(atan2(sin(radians(lon - 31.0)) * cos(radians(lat)), cos(radians(48.0)) * sin(radians(lat)) - sin(radians(48.0)) * cos(radians(lat)) * cos(radians(lon - 31.0)))) AS deg, {_KM.format('48.0::DOUBLE', '31.0::DOUBLE', 'lat', 'lon')} AS km FROM c) SELECT floor((deg + CASE WHEN deg < 0 THEN 360 ELSE 0 END) / 45)::BIGINT AS octant, (lat BETWEEN 46 AND 50 AND lon BETWEEN 28 AND 34 AND NOT (lat BETWEEN 47 AND 49 AND lon BETWEEN 30 AND 32)) AS inside, count(*) AS n, round(avg(km), 2) AS avg_km FROM b GROUP BY 1, 2",
    "graph_degrees": f"WITH {_EDGES}, t AS (SELECT * FROM e ORDER BY weight DESC, source, target LIMIT 200), u AS (SELECT 'c' || source AS node, 1 AS o, 0 AS i, weight FROM t UNION ALL SELECT 's' || target, 0, 1, weight FROM t) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(weight)::BIGINT AS weight FROM u GROUP BY node",
    "top_forwarders": f"WITH {_EDGES} SELECT source, sum(weight)::BIGINT AS total, count(*) AS targets FROM e GROUP BY source ORDER BY total DESC, source LIMIT 20",
    "lineage": f"WITH {_EDGES} SELECT 'out' AS way, target AS other, weight FROM e WHERE source = 7 UNION ALL SELECT 'in', source, weight FROM e WHERE target = 7",
    "consensus": f"WITH {_EVIDENCE}, m AS (SELECT nation, sum(w * lat) / sum(w) AS a, sum(w * lon) / sum(w) AS b, avg(confidence) AS c, min(radius_m) AS r, count(*) AS n, arg_max(source, (confidence, -radius_m, source)) AS s FROM e GROUP BY 1), d AS (SELECT e.nation, max({_KM.format('e.lat', 'e.lon', 'a', 'b')}) * 1000 AS off FROM e JOIN m USING (nation) GROUP BY 1) SELECT m.nation, CASE WHEN off > 2000 OR n = 1 THEN s::VARCHAR ELSE 'consensus' END AS source, round(CASE WHEN off > 2000 OR n = 1 THEN e.lat ELSE a END, 5) AS lat, round(CASE WHEN off > 2000 OR n = 1 THEN e.lon ELSE b END, 5) AS lon, round(CASE WHEN off > 2000 OR n = 1 THEN e.confidence ELSE least(1.0, c + 0.15) END, 4) AS confidence, round(CASE WHEN n = 1 THEN e.radius_m WHEN off > 2000 THEN greatest(e.radius_m, off) ELSE greatest(10.0, r * 0.8) END, 1) AS radius_m, off > 2000 AS conflict FROM m JOIN d USING (nation) JOIN e ON e.nation = m.nation AND e.source = m.s",
    "fused_centres": f"WITH {_EVIDENCE}, u AS (SELECT *, confidence / pow(greatest(radius_m, 50.0), 2) AS v FROM e WHERE confidence >= 0.3), m AS (SELECT nation, sum(v * lat) / sum(v) AS a, sum(v * lon) / sum(v) AS b, sqrt(sum(v * pow(radius_m, 2)) / sum(v)) AS r, count(*) AS n, avg(confidence) AS c, max(reliability) AS rel, min(credibility) AS cred FROM u GROUP BY 1), k AS (SELECT nation, count(*) FILTER (confidence > 0.5 AND sqrt(pow((lat - a) * 111320.0, 2) + pow((lon - b) * 111320.0 * cos(radians(a)), 2)) > 2 * radius_m) AS conflicts FROM u JOIN m USING (nation) GROUP BY 1) SELECT nation, round(a, 6) AS lat, round(b, 6) AS lon, round(r, 1) AS radius_m, n AS sources, conflicts, round(c, 3) AS confidence, substr('FEDCBA', rel, 1) || cred || CASE WHEN conflicts > 0 THEN '!' ELSE '' END AS grade FROM m JOIN k USING (nation)",
    "similar_images": f"WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.label = b.label AND b.k < a.k AND b.k >= a.k - {LOOKBACK}) SELECT vec_id, max(other_id) AS other_id, arg_max(cosine, other_id) AS cosine FROM p WHERE cosine >= {ALIKE} GROUP BY 1",
    "similar_hashes": f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, doc_id + floor(doc_id / 300) * 500 AS hour, list_aggregate([substr(md5(substr(text, (length(text) * i // 16 + 1)::BIGINT, (length(text) * (i + 1) // 16 - length(text) * i // 16)::BIGINT)), 1, 1) FOR i IN range(0, 16)], 'string_agg', '') AS h FROM documents), v AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2 FROM d), p AS (SELECT a.doc_id, b.doc_id AS other_id, b.k, bit_count(xor(a.h1, b.h1)) + bit_count(xor(a.h2, b.h2)) AS bits FROM v a JOIN v b ON b.k < a.k AND b.k >= a.k - {LOOKBACK} AND b.hour >= a.hour - 720) SELECT doc_id, arg_max(other_id, k) AS other_id, greatest(50, 100 - arg_max(bits, k) * 10)::INTEGER AS score FROM p WHERE bits <= 5 GROUP BY doc_id",
}
