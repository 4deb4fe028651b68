"""Addresses, coordinate literals, place names, regions and tracks over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo, places
from tidewatch.operators import addresses, rules, tracks
from tidewatch.operators import places as place_joins

# Fixed values of the synthetic rule tables.
REPORT_RULES = rules.Tables(
    types=(("credential", ("password", "secret"), ()), ("licence", ("license", "copyright"), ("reserved", "public")), ("contact", ("@", "http"), ()), ("prose", ("the ", " la ", "und "), ())),
    places=(("Thon", "east", ("thon ", "thor")), ("Erin", "west", ("erin", "eron")), ("Ouville", "west", ("oue", "oui"))),
    outside=(("south", ("ñ", "ción")), ("north", ("ung ", "keit"))),
    explicit=("here", "aquí"),
    noise=("lorem", "$$"),
    guards=("of", "in", "la"),
)
STREETS = addresses.Rules(
    before={"street": ("street", "st."), "avenue": ("avenue",)}, after={"road": ("road",)}, cities=(("Riverton", "Riverton"), ("Old Port", "Old Port")),
    districts=(("mill", "Mill Hill", "Riverton"), ("quay", "Quayside", "Old Port")), city="Capital",
)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _place(key: str):
    k = F.col(key)
    return (F.lit(44.0) + k * 7919 % 850 / 100.0).alias("lat"), (F.lit(22.0) + k * 104729 % 1800 / 100.0).alias("lon")


def coordinate_literals(spark, sf):
    """Positions written in degrees, minutes and seconds, read back."""
    c = _read(spark, sf, "customer")
    k = F.col("c_custkey")
    deg = lambda d, m, s, side: F.concat(d.cast("string"), F.lit("°"), m.cast("string"), F.lit("'"), s.cast("string"), F.lit('"' + side))
    line = F.concat(F.lit("seen at "), deg(k % 90, k % 60, k * 7 % 60, "S"), F.lit(" "), deg(k % 180, k * 3 % 60, k % 59, "E"), F.lit("."))
    lat, lon = places.dms_point(F.when(k % 5 > 0, line).otherwise("nowhere"))
    return c.select("c_custkey", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


def toponyms(spark, sf):
    """Place texts of customers against the nations: homonyms of the segment first, then exact names, then the longest name within."""
    n = _read(spark, sf, "nation").select(F.lower("n_name").alias("key"))
    k = F.col("c_custkey")
    name = F.concat(F.lit("Nation_"), k % 30)
    text = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("near "), name, F.lit(" bridge"))).when(k % 4 == 2, F.lit("Old Town")).otherwise(F.lit("unknown"))
    homonyms = _read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("region")).agg(F.concat(F.lit("nation_"), F.min("c_nationkey")).alias("key")).withColumn("name", F.lit("old town"))
    at = _read(spark, sf, "customer").select(k.alias("id"), text.alias("place"), F.col("c_mktsegment").alias("region"))
    return place_joins.resolve(at, n, homonyms).groupBy("how", "key").agg(F.count(F.lit(1)).alias("n"))


def movement_phrases(spark, sf):
    """Bearing, distance and minutes of "from X toward Y" between the nations' places; left out where a name is not known."""
    g = _read(spark, sf, "nation").select(F.lower("n_name").alias("name"), *_place("n_nationkey"))
    k = F.col("c_custkey")
    said = _read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Seen from NATION_"), k % 27, F.lit(" toward NATION_"), k * 7 % 26, F.lit(".")).alias("text"))
    x, y = places.movement(F.col("text"))
    origin = g.select(F.col("name").alias("origin"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    goal = g.select(F.col("name").alias("goal"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    m = said.select("c_custkey", x.alias("origin"), y.alias("goal")).where("origin <> goal").join(origin, "origin").join(goal, "goal")
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    km = geo.haversine_km(*ends)
    return m.select("c_custkey", F.round(geo.bearing(*ends), 2).alias("bearing"), F.round(km, 2).alias("km"), F.round(km / 180.0 * 60, 1).alias("minutes"))


def district_tags(spark, sf):
    """Documents by the districts whose alias words they hold."""
    alias = spark.createDataFrame([("the", "center"), ("of", "center"), ("le", "west"), ("la", "west"), ("und", "north"), ("der", "north"), ("el", "south"), ("que", "south")], "alias string, district string")
    tags = place_joins.tagged(_read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), alias)
    return tags.groupBy(F.array_join("tags", ",").alias("tags")).agg(F.count(F.lit(1)).alias("n"))


def region_approach(spark, sf):
    """Customers as moving points against the nations as regions: how many are within or inbound, and the soonest."""
    k = F.col("c_custkey")
    moving = _read(spark, sf, "customer").select(k.alias("id"), *_place("c_custkey"), (k * 37 % 360).cast("double").alias("heading"), (k % 5 * 45.0).alias("kmh"))
    regions = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("other_id"), *_place("n_nationkey"), (F.lit(20.0) + F.col("n_nationkey") % 4 * 10).alias("radius"))
    a = place_joins.approaching(moving, regions)
    return a.groupBy("region", "way").agg(F.count(F.lit(1)).alias("n"), F.min("minutes").alias("soonest"), F.round(F.avg("km"), 2).alias("avg_km"))


def classified_documents(spark, sf):
    """Documents by type, region and place of ordered rule tables, and whether they are taken."""
    d = rules.classified(_read(spark, sf, "documents").select("doc_id", "text"), REPORT_RULES)
    return d.groupBy("type", "region", "place", "accepted").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def address_mentions(spark, sf):
    """A row for each address that a customer's report names: street, building, district, city and where it stands in the text."""
    return addresses.address_rows(_address_texts(spark, sf), STREETS).select("id", "street", "building", "district", "city", "precision", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def _address_texts(spark, sf) -> DataFrame:
    """Reports made of each customer's key: two streets with names of up to three words, a road with a word behind its name, or none."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*map(F.lit, ("Saint Mary Ann", "Green", "Long Field"))), (k % 3 + 1).cast("int"))
    city = F.element_at(F.array(*map(F.lit, (", in Riverton", ", in Old Port", ""))), (k % 7 % 3 + 1).cast("int"))
    stem = F.element_at(F.array(*map(F.lit, (" near the mill", " by the quay", ""))), (k % 5 % 3 + 1).cast("int"))
    line = (
        F.when(k % 4 == 0, F.concat(F.lit("Smoke on street "), name, F.lit(", "), k % 90 + 1, F.lit("b"), city, F.lit("; cars on avenue "), name, stem))
        .when(k % 4 == 1, F.concat(F.lit("water at st. "), name, F.lit(" "), k % 300, stem, city))
        .when(k % 4 == 2, F.concat(F.lit("stopped on "), name, F.lit(" road at "), k % 40 + 1, city))
        .otherwise(F.concat(F.lit("no street"), city))
    )
    keys = _read(spark, sf, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file would be one task
    return keys.select(k.alias("id"), line.alias("text"))


def smoothed_tracks(spark, sf):
    """Speed, heading and arrival interval after every report of a source, smoothed; a source moves along a line with scatter."""
    e = _read(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0)
    drift = F.col("t") % 86400.0 / 60.0
    at = e.select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), "t", (drift + F.col("event_id") % 7).alias("x"), (drift * 0.5 + F.col("event_id") % 5).alias("y"))
    s = tracks.smooth(at)
    soon, nominal, late = geo.arrival_minutes(F.lit(50.0), F.hypot("vx", "vy"), F.col("sigma"))
    heading = F.pmod(F.degrees(F.atan2("vx", "vy")), F.lit(360.0))
    return s.select("track", "id", F.round(F.hypot("vx", "vy"), 3).alias("kmh"), F.round(heading, 2).alias("heading"), F.round(soon, 2).alias("soonest"), F.round(nominal, 2).alias("nominal"), F.round(late, 2).alias("latest"))


QUERIES = {f.__name__: f for f in (coordinate_literals, toponyms, movement_phrases, district_tags, region_approach, smoothed_tracks, classified_documents, address_mentions)}

_LAT, _LON = "44.0::DOUBLE + ({0} * 7919 % 850) / 100.0::DOUBLE", "22.0::DOUBLE + ({0} * 104729 % 1800) / 100.0::DOUBLE"
_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_WAY = "degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1}))))"
_FOUR = ("lat1", "lon1", "lat2", "lon2")

ORACLE = {
    "coordinate_literals": "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN round(-((c_custkey % 90) + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey * 7 % 60) / 3600.0::DOUBLE), 5) END AS lat, CASE WHEN c_custkey % 5 > 0 THEN round((c_custkey % 180) + (c_custkey * 3 % 60) / 60.0::DOUBLE + (c_custkey % 59) / 3600.0::DOUBLE, 5) END AS lon FROM customer",
    "toponyms": "WITH h AS (SELECT c_mktsegment, 'nation_' || min(c_nationkey) AS homonym FROM customer GROUP BY 1), c AS (SELECT c_custkey AS id, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN 'nation_' || (c_custkey % 30) WHEN 1 THEN 'near nation_' || (c_custkey % 30) || ' bridge' WHEN 2 THEN 'old town' ELSE 'unknown' END AS place FROM customer), f AS (SELECT id, arg_max(lower(n_name), length(n_name)) AS inside FROM c JOIN nation ON contains(place, lower(n_name)) GROUP BY 1), r AS (SELECT CASE WHEN place = 'old town' THEN 'homonym' WHEN inside = place THEN 'exact' WHEN inside IS NOT NULL THEN 'inside' ELSE 'unresolved' END AS how, CASE WHEN place = 'old town' THEN homonym ELSE inside END AS key FROM c LEFT JOIN f USING (id) LEFT JOIN h USING (c_mktsegment)) SELECT how, key, count(*) AS n FROM r GROUP BY 1, 2",
    "movement_phrases": f"WITH g AS (SELECT n_nationkey AS k, {_LAT.format('n_nationkey')} AS lat, {_LON.format('n_nationkey')} AS lon FROM nation), m AS (SELECT c_custkey, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM customer JOIN g a ON a.k = c_custkey % 27 JOIN g b ON b.k = c_custkey * 7 % 26 WHERE a.k <> b.k), d AS (SELECT c_custkey, {_WAY.format(*_FOUR)} AS deg, {_KM.format(*_FOUR)} AS km FROM m) SELECT c_custkey, round(deg + CASE WHEN deg < 0 THEN 360 ELSE 0 END, 2) AS bearing, round(km, 2) AS km, round(km / 180.0::DOUBLE * 60, 1) AS minutes FROM d",
    "district_tags": r"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS alias FROM documents), a AS (SELECT * FROM (VALUES ('the', 'center'), ('of', 'center'), ('le', 'west'), ('la', 'west'), ('und', 'north'), ('der', 'north'), ('el', 'south'), ('que', 'south')) v(alias, district)), t AS (SELECT doc_id, string_agg(DISTINCT district, ',' ORDER BY district) AS tags FROM w JOIN a USING (alias) GROUP BY 1) SELECT tags, count(*) AS n FROM t GROUP BY 1",
    "region_approach": f"WITH p AS (SELECT c_custkey AS id, {_LAT.format('c_custkey')} AS lat1, {_LON.format('c_custkey')} AS lon1, c_custkey * 37 % 360 AS heading, (c_custkey % 5) * 45.0::DOUBLE AS kmh FROM customer), r AS (SELECT n_nationkey::BIGINT AS region, {_LAT.format('n_nationkey')} AS lat2, {_LON.format('n_nationkey')} AS lon2, 20.0::DOUBLE + (n_nationkey % 4) * 10 AS radius FROM nation), d AS (SELECT *, {_KM.format(*_FOUR)} AS km, abs(heading - ({_WAY.format(*_FOUR)})) AS raw FROM p, r), o AS (SELECT *, CASE WHEN raw > 360 THEN raw - 360 ELSE raw END AS m FROM d), w AS (SELECT region, km, kmh, CASE WHEN km <= radius THEN 'direct' WHEN km <= 160 AND (least(m, 360 - m) <= 65 OR km <= 100) THEN 'inbound' END AS way FROM o) SELECT region, way, count(*) AS n, min(CASE WHEN kmh > 0 THEN round(km / kmh * 60) END) AS soonest, round(avg(km), 2) AS avg_km FROM w WHERE way IS NOT NULL GROUP BY 1, 2",
    "classified_documents": r"WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents), f AS (SELECT doc_id, CASE WHEN regexp_matches(x, 'lorem|\$\$') THEN NULL WHEN regexp_matches(x, 'password|secret') THEN 'credential' WHEN regexp_matches(x, 'license|copyright') THEN CASE WHEN regexp_matches(x, 'reserved|public') THEN 'licence' END WHEN regexp_matches(x, '@|http') THEN 'contact' WHEN regexp_matches(x, 'the | la |und ') THEN 'prose' END AS type, CASE WHEN (contains(x, 'thon ') AND NOT regexp_matches(x, '(of|in|la)\s+thon ')) OR (contains(x, 'thor') AND NOT regexp_matches(x, '(of|in|la)\s+thor')) THEN 'Thon' WHEN (contains(x, 'erin') AND NOT regexp_matches(x, '(of|in|la)\s+erin')) OR (contains(x, 'eron') AND NOT regexp_matches(x, '(of|in|la)\s+eron')) THEN 'Erin' WHEN (contains(x, 'oue') AND NOT regexp_matches(x, '(of|in|la)\s+oue')) OR (contains(x, 'oui') AND NOT regexp_matches(x, '(of|in|la)\s+oui')) THEN 'Ouville' END AS place, regexp_matches(x, 'here|aquí') AS explicit, CASE WHEN regexp_matches(x, 'ñ|ción') THEN 'south' WHEN regexp_matches(x, 'ung |keit') THEN 'north' END AS outer_region FROM t), r AS (SELECT *, CASE WHEN NOT explicit THEN outer_region END AS outside FROM f) SELECT type, coalesce(outside, CASE place WHEN 'Thon' THEN 'east' WHEN 'Erin' THEN 'west' WHEN 'Ouville' THEN 'west' END, CASE WHEN explicit THEN 'home' END) AS region, place, type IS NOT NULL AND outside IS NULL AS accepted, count(*) AS n, min(doc_id) AS first_id FROM r GROUP BY 1, 2, 3, 4",
    "address_mentions": r"WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Saint Mary Ann' WHEN 1 THEN 'Green' ELSE 'Long Field' END AS name, CASE c_custkey % 7 % 3 WHEN 0 THEN ', in Riverton' WHEN 1 THEN ', in Old Port' ELSE '' END AS city, CASE c_custkey % 5 % 3 WHEN 0 THEN ' near the mill' WHEN 1 THEN ' by the quay' ELSE '' END AS stem FROM customer), t AS (SELECT id, CASE id % 4 WHEN 0 THEN 'Smoke on street ' || name || ', ' || (id % 90 + 1) || 'b' || city || '; cars on avenue ' || name || stem WHEN 1 THEN 'water at st. ' || name || ' ' || (id % 300) || stem || city WHEN 2 THEN 'stopped on ' || name || ' road at ' || (id % 40 + 1) || city ELSE 'no street' || city END AS text FROM c), p AS (SELECT id, text, unnest([regexp_extract(text, 'street (?:[A-Z][a-z]+ ?)+', 0), regexp_extract(text, 'st\. (?:[A-Z][a-z]+ ?)+', 0), regexp_extract(text, 'avenue (?:[A-Z][a-z]+ ?)+', 0), regexp_extract(text, '(?:[A-Z][a-z]+ )+road', 0)]) AS found FROM t), q AS (SELECT id, text, trim(found) AS found, CASE WHEN contains(text, 'Riverton') THEN 'Riverton' WHEN contains(text, 'Old Port') THEN 'Old Port' END AS town FROM p WHERE found <> ''), w AS (SELECT *, instr(text, found) - 1 AS start, instr(text, found) - 1 + length(found) AS stop FROM q), b AS (SELECT *, nullif(regexp_extract(substr(text, stop + 1, 25), '(?:^|[^A-Za-z0-9])([1-9][0-9]{0,3}[a-z]?)(?:[^A-Za-z0-9]|$)', 1), '') AS building, CASE WHEN contains(text, ' mill') AND coalesce(town, 'Riverton') = 'Riverton' THEN 'Mill Hill' WHEN contains(text, ' quay') AND coalesce(town, 'Old Port') = 'Old Port' THEN 'Quayside' END AS district FROM w) SELECT id, replace(found, 'st. ', 'street ') AS street, building, district, coalesce(town, CASE district WHEN 'Mill Hill' THEN 'Riverton' WHEN 'Quayside' THEN 'Old Port' END, 'Capital') AS city, CASE WHEN building IS NULL THEN 'street' ELSE 'address' END AS precision, start::INTEGER AS start_at, stop::INTEGER AS end_at FROM b",
}
