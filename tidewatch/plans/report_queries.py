"""Views of recent reports, acceptance rules, contexts, duplicates, re-scoring and checks of reports.

``as_of`` is the newest timestamp of the table. Positions, regions, sources and texts are derived from keys by formulas that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import geo, places, scoring, text
from tidewatch.operators import incidents, spatial, views
from tidewatch.operators import places as place_joins

# Fixed values of the synthetic rule tables.
KEYWORDS = ["1", "3", "7"]
TYPES = ["click", "error", "purchase"]
CONTEXTS = [("capital", ["city of", "capital"]), ("coast", ["harbour", "port"]), ("north", ["north"])]
NOISE, DIGESTS, STRONG, WANTED = ["die", "el"], ["les"], ["und"], ["the", "und", "la"]
SIGNATURES = [("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("mail", r"[a-z0-9._]+@[a-z0-9.-]+"), ("link", r"https?://"), ("digest", r"[0-9a-f]{32}")]
ALIASES = [("harbour", ["the port", "la", "harbour"]), ("bridge", ["un", "old bridge"]), ("market", ["und", "market"]), ("mill", ["de"])]
SECTORS = [(f"s{k:02d}", 44.5 + k * 3 % 8, 22.5 + k * 5 % 18) for k in range(12)]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events")


def _as_of(df: DataFrame):
    return df.agg(F.max("ts")).first()[0]


def _place(key: str):
    k = F.col(key)
    return (F.lit(44.0) + k * 7919 % 850 / 100.0).alias("lat"), (F.lit(22.0) + k * 104729 % 1800 / 100.0).alias("lon")


def _reports(spark, sf) -> DataFrame:
    """Events as reports: channel, text, type, position, scores, flags and status."""
    u, i = F.col("user_id"), F.col("event_id")
    channel = F.concat(F.when(u % 29 == 0, "Test_").otherwise("chan_"), u)
    sig, conf = (F.col("value") % 100).cast("int"), (u % 10 * 10).cast("int")
    return _events(spark, sf).select(
        i.alias("id"), channel.alias("channel"), (i % 1000).alias("message_id"), F.concat(F.lit("k "), "props").alias("text"), "ts", "event_type", *_place("user_id"),
        sig.alias("significance"), conf.alias("confidence"), scoring.composite(sig, conf).alias("resonance"), F.concat(F.lit("INC-"), u).alias("incident_id"), F.lit("OPEN").alias("stage"),
        (i % 3 == 0).alias("has_media"), (i % 11 == 0).alias("is_fallback"), (u % 7 == 0).alias("is_official"), (u % 4 + 1).alias("sources_count"), F.when(u % 7 == 0, "OFFICIAL").otherwise("SINGLE").alias("status"),
        F.lit(500).alias("radius_m"),
    )


def recent_events(spark, sf):
    """The wide view of a day's reports in a box without its inner box: no test channels, no fallback positions, no unofficial plain views without a keyword."""
    r = _reports(spark, sf)
    out = views.recent(r, _as_of(r), 24, box=(46.0, 24.0, 51.0, 38.0), inner=(48.0, 28.0, 49.5, 33.0), types=None, generic=("view", KEYWORDS))
    return out.select(*views.COLUMNS)


def window_sizes(spark, sf):
    """How many reports windows of several lengths take: none for one that is not positive."""
    r = _reports(spark, sf)
    now, out = _as_of(r), None
    for hours in (-3, 0, 1, 24):
        part = views.recent(r, now, hours, types=TYPES).agg(F.count(F.lit(1)).alias("n")).select(F.lit(hours).alias("hours"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def region_boxes(spark, sf):
    """Customers by the boxes of a region table they lie in, inclusive; boxes may overlap."""
    k = F.col("n_nationkey")
    boxes = _table(spark, sf, "nation").select(F.lower("n_name").alias("region"), (F.lit(44.0) + k % 5 * 1.5).alias("south"), (F.lit(22.0) + k * 3 % 16).alias("west"))
    boxes = boxes.withColumns({"north": F.col("south") + 1.75, "east": F.col("west") + 2.25})
    c = _table(spark, sf, "customer").select("c_custkey", *_place("c_custkey"))
    return views.in_boxes(c, boxes).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def acceptance(spark, sf):
    """Why documents would not be taken as reports, by reason; accepted ones have none."""
    d = _table(spark, sf, "documents")
    i, has = F.col("doc_id"), lambda terms: text.contains_any(F.col("text"), terms)
    reason = text.acceptance(
        F.when(i % 31 == 0, "").otherwise(F.col("text")), i % 62 == 0, i % 37 == 0, i % 41 == 0, has(DIGESTS), has(NOISE), has(STRONG), has(WANTED), F.col("lang") == "fr", i % 5 > 0,
    )
    return d.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def context_order(spark, sf):
    """Context of a place phrase: the first of ordered rules that holds."""
    k = F.col("c_custkey")
    said = F.concat(F.lit("seen "), F.when(k % 2 == 0, "north of the harbour ").otherwise("by the road "), F.when(k % 3 == 0, "near the city of x").when(k % 5 == 0, "and the port"))
    c = _table(spark, sf, "customer").select(F.coalesce(said, F.when(k % 2 == 0, "north of the harbour ").otherwise("by the road ")).alias("t"))
    return c.groupBy(text.first_match(F.col("t"), CONTEXTS, "none").alias("context")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_raise(spark, sf):
    """Repeated (channel, message) reports: the first stands with the best scores of all and the type of the last."""
    r = _reports(spark, sf).withColumn("message_id", F.col("id") % 40)
    out = incidents.raised(r.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))), ["channel", "message_id"])
    return out.select("channel", "message_id", "id", "n", "significance", "confidence", "resonance", "event_type")


def rescored(spark, sf):
    """All reports scored anew: how the composite moves, by type."""
    r = _reports(spark, sf)
    sig = scoring.significance(F.col("event_type"), {"error": 80.0, "purchase": 60.0, "signup": 45.0, "click": 20.0}, F.when(F.col("has_media"), 5).otherwise(0))
    conf = scoring.confidence(F.col("sources_count"), F.col("sources_count") * 0.5, F.when(F.col("is_official"), 1).otherwise(0), F.col("sources_count") % 2, F.lit(False), F.col("has_media"))
    new = r.select("event_type", "resonance", scoring.composite(sig, conf).alias("fresh"))
    return new.groupBy("event_type").agg(F.sum("resonance").cast("long").alias("before"), F.sum("fresh").cast("long").alias("after"), F.count_if(F.col("fresh") > F.col("resonance")).alias("raised"))


def region_rewrite(spark, sf):
    """The audit's rewrite: noise goes, reports outside their box get another region, those without position its centre."""
    e = _events(spark, sf).select("event_id", "event_type", (F.col("user_id") % 8).alias("region"), F.when(F.col("event_id") % 13 > 0, F.lit(44.0) + F.col("user_id") * 7919 % 850 / 100.0).alias("lat"), "value")
    kept = e.where(~((F.col("event_type") == "view") & (F.col("value") < 10)))
    centre = F.lit(44.5) + F.col("region")
    region = F.when(F.col("lat").isNull() | F.col("lat").between(centre - 0.5, centre + 0.5), F.col("region")).otherwise(F.floor(F.col("lat") - 44))
    out = kept.select(region.alias("region"), (F.col("region") != region).alias("moved"), F.col("lat").isNull().alias("filled"), F.coalesce("lat", centre).alias("lat"))
    return out.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("moved"), F.count_if("filled").alias("filled"), F.round(F.avg("lat"), 3).alias("lat"))


def thermal_top(spark, sf):
    """The five most intense errors that are out of their holdback, in degrees Celsius."""
    e = _events(spark, sf)
    due = e.where((F.col("event_type") == "error") & (F.col("value") >= 15) & (F.col("ts") <= F.lit(_as_of(e)) - F.expr("INTERVAL 3 HOURS")))
    return due.orderBy(F.desc("value"), "event_id").limit(5).select("event_id", F.col("value").alias("intensity"), F.round(F.lit(300.0) + F.col("value") - 273.15, 2).alias("celsius"))


def last_movements(spark, sf):
    """The ten newest reports with the ends of the movement phrase in their text, if there is one."""
    u = F.col("user_id")
    e = _events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    a, b = places.movement(F.when(u % 3 > 0, F.concat(F.lit("from Place_"), u % 9, F.lit(" toward Place_"), u % 7, F.lit("."))).otherwise("quiet"))
    return e.select("event_id", a.alias("origin"), b.alias("goal"))


def _digest(spark, sf, hours: int, least: float):
    """Reports of the last hours, without those whose incident or signature was on one kept before, newest first."""
    e = _events(spark, sf)
    r = e.where((F.col("ts") >= F.lit(_as_of(e)) - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("value") >= least))
    r = r.select(F.lit(1).alias("window"), F.col("event_id").alias("id"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), F.col("user_id").alias("incident"),
                 F.when(F.col("event_type") != "view", F.floor("value").cast("string")).alias("signature"))
    return incidents.unseen(r, ["window"]).orderBy("t", "id")


def half_day_report(spark, sf):
    """The first ten of the last 12 hours' reports, newest first, without repeated incidents or signatures."""
    return _digest(spark, sf, 12, 0.0).limit(10).select("id", "incident", "signature")


def hour_activity(spark, sf):
    """The last hour's reports of some weight, newest first, without repeated incidents or signatures."""
    return _digest(spark, sf, 1, 5.0).select("id", "incident", "signature")


def text_signatures(spark, sf):
    """Documents by the patterns of a defensive rule table that they hold."""
    d = _table(spark, sf, "documents")
    found = F.filter(F.array(*(F.when(F.lower("text").rlike(p), F.lit(n)) for n, p in SIGNATURES)), lambda x: x.isNotNull())
    return d.groupBy(F.array_join(found, ",").alias("rules")).agg(F.count(F.lit(1)).alias("n"))


def alias_matches(spark, sf):
    """First place, in the order of the table, one of whose aliases stands between boundaries in a document."""
    d = _table(spark, sf, "documents")
    return d.groupBy(F.coalesce(text.first_alias(F.col("text"), ALIASES), F.lit("none")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


def channel_regions(spark, sf):
    """Regions of channels: their own name in the registry, else a registered name within it, else a region's stem in it."""
    c = _table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("@Nation_"), k % 30)).when(k % 4 == 1, F.concat(F.lit("live_nation_"), k % 30, F.lit("_now"))).when(k % 4 == 2, F.concat(F.lit("news "), F.col("c_mktsegment"))).otherwise("other")
    registry = _table(spark, sf, "nation").select(F.lower("n_name").alias("name"), F.concat(F.lit("region_"), "n_regionkey").alias("region"))
    stems = [("autos", "automo"), ("homes", "household"), ("works", "machinery")]
    r = place_joins.channel_regions(c.select(k.alias("id"), name.alias("channel")), registry, stems)
    return r.groupBy("how", "region").agg(F.count(F.lit(1)).alias("n"))


def _said(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    street = F.concat(F.lit("rue "), F.element_at(F.array(*map(F.lit, ("Lilas", "Haute", "Neuve"))), (k % 3 + 1).cast("int")))
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("at "), F.round(F.lit(44.0) + k * 7919 % 850 / 100.0, 3).cast("decimal(9,4)"), F.lit(", "), F.round(F.lit(22.0) + k * 104729 % 1800 / 100.0, 3).cast("decimal(9,4)")))
        .when(k % 5 == 1, F.concat(F.lit("in Alba, "), street, F.lit(" "), k % 90))
        .when(k % 5 == 2, F.concat(F.lit("on "), street, F.lit(", "), k % 90, F.lit("b")))
        .when(k % 5 == 3, F.lit("somewhere in Borg"))
        .otherwise("no place at all")
    )
    return _table(spark, sf, "customer").select(k.alias("id"), line.alias("text"))


CITIES = [("alba", 46.5, 24.5), ("borg", 48.25, 30.75)]


def _located(spark, sf) -> DataFrame:
    return _said(spark, sf).select("id", places.located(F.col("text"), CITIES).alias("l"))


def located_texts(spark, sf):
    """Places in report texts with their kind and confidence: coordinates, addresses, or a settlement alone."""
    out = _located(spark, sf).select(F.col("l.kind").alias("kind"), F.col("l.confidence").alias("confidence"), F.col("l.building").isNotNull().alias("building"), F.col("l.lat").alias("lat"))
    return out.groupBy("kind", "confidence", "building").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lat"), 3).alias("lat"))


def street_addresses(spark, sf):
    """Streets named in report texts, with their buildings, by street."""
    d = _said(spark, sf).select(F.explode(places.addresses(F.col("text"))).alias("a"))
    return d.groupBy("a.street").agg(F.count(F.lit(1)).alias("n"), F.count("a.building").alias("with_building"))


def report_checks(spark, sf):
    """Statuses of located reports by what else is known near by: another warning in the region, a public place, and the kind of location."""
    at = _located(spark, sf).select("id", "l.kind", F.col("l.lat").alias("lat"), F.col("l.lon").alias("lon"))
    located = at.where("lat is not null").select("id", "lat", "lon")
    warn = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("other_id"), *_place("n_nationkey"))
    sites = _table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("other_id"), *_place("s_suppkey"))
    nearest = lambda other, km, name: spatial.within_km(located, other, km).groupBy("id").agg(F.min("km").alias(name))
    out = at.join(nearest(warn, 25.0, "warning_km"), "id", "left").join(nearest(sites, 3.0, "site_km"), "id", "left")
    score, status = scoring.checked(F.col("kind"), F.col("lat").isNotNull(), F.col("warning_km"), F.col("site_km"))
    return out.groupBy(status.alias("status"), score.alias("score")).agg(F.count(F.lit(1)).alias("n"))


def nearest_sector(spark, sf):
    """The nearest of twelve sector centres to every customer, by plain squared degrees with shrunk longitudes."""
    c = _table(spark, sf, "customer").select("c_custkey", *_place("c_custkey"))
    return c.groupBy(geo.nearest_of(F.col("lat"), F.col("lon"), SECTORS).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


def subscriptions(spark, sf):
    """Subscribers to be told of each error: those whose districts, with their aliases, hold one of its tags."""
    groups = F.array(*(F.array(F.lit(f"d{k}"), F.lit(f"area{k}")) for k in range(6)))
    k = F.col("c_custkey")
    own = F.array(F.concat(F.lit("d"), k % 6), F.concat(F.lit("d"), k * 5 % 7))
    subscribed = F.array_distinct(F.concat(own, F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, own)))))
    s = _table(spark, sf, "customer").select(k.alias("subscriber"), F.explode(subscribed).alias("tag"))
    e = _events(spark, sf).where("event_type = 'error'").select("event_id", F.explode(F.array_distinct(F.array(F.concat(F.lit("area"), F.col("user_id") % 8), F.concat(F.lit("d"), F.col("event_id") % 9)))).alias("tag"))
    told = s.join(e.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "tag")
    return told.groupBy("subscriber").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("tags"))


QUERIES = {f.__name__: f for f in (
    recent_events, window_sizes, region_boxes, acceptance, context_order, duplicate_raise, rescored, region_rewrite, thermal_top, last_movements, half_day_report, hour_activity,
    text_signatures, alias_matches, channel_regions, located_texts, street_addresses, report_checks, nearest_sector, subscriptions,
)}

_NOW = "(SELECT max(ts) FROM events)"
_LAT, _LON = "44.0::DOUBLE + ({0} * 7919 % 850) / 100.0::DOUBLE", "22.0::DOUBLE + ({0} * 104729 % 1800) / 100.0::DOUBLE"
_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_ANY = lambda terms: f"regexp_matches(lower(text), '{'|'.join(terms)}')"
_R = f"""r AS (SELECT event_id AS id, CASE WHEN user_id % 29 = 0 THEN 'Test_' ELSE 'chan_' END || user_id AS channel, event_id % 1000 AS message_id, 'k ' || props AS text, ts, event_type,
 {_LAT.format('user_id')} AS lat, {_LON.format('user_id')} AS lon, floor(value % 100)::INTEGER AS significance, (user_id % 10 * 10)::INTEGER AS confidence, 'INC-' || user_id AS incident_id, 'OPEN' AS stage,
 event_id % 3 = 0 AS has_media, event_id % 11 = 0 AS is_fallback, user_id % 7 = 0 AS is_official, user_id % 4 + 1 AS sources_count, CASE WHEN user_id % 7 = 0 THEN 'OFFICIAL' ELSE 'SINGLE' END AS status, 500 AS radius_m FROM events),
 q AS (SELECT *, greatest(10, least(100, floor(0.55::DOUBLE * significance + 0.45::DOUBLE * confidence)))::INTEGER AS resonance FROM r)"""
_STREET = "'rue ' || CASE c_custkey % 3 WHEN 0 THEN 'Lilas' WHEN 1 THEN 'Haute' ELSE 'Neuve' END"
_LOCATED = f"""l AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'coordinate' WHEN 1 THEN 'address' WHEN 2 THEN 'address' WHEN 3 THEN 'settlement' END AS kind,
 CASE c_custkey % 5 WHEN 0 THEN 0.98 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 WHEN 3 THEN 0.65 END::DOUBLE AS confidence, c_custkey % 5 IN (1, 2) AS building,
 CASE c_custkey % 5 WHEN 0 THEN {_LAT.format('c_custkey')} WHEN 1 THEN 46.5 WHEN 3 THEN 48.25 END::DOUBLE AS lat, CASE c_custkey % 5 WHEN 0 THEN {_LON.format('c_custkey')} WHEN 1 THEN 24.5 WHEN 3 THEN 30.75 END::DOUBLE AS lon FROM customer)"""
_BOUND = r"[ \n\t\r,.;:!?()«»\"'-]"
_ALIAS = " ".join(f"WHEN regexp_matches(lower(text), '(^|{_BOUND})({'|'.join(sorted([n, *a]))})($|{_BOUND})') THEN '{n}'" for n, a in ALIASES).replace("'-]", "''-]")
_SECTOR = " UNION ALL ".join(f"SELECT '{n}' AS sector, {a}::DOUBLE AS slat, {b}::DOUBLE AS slon" for n, a, b in SECTORS)
_UNSEEN = """WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS incident, CASE WHEN event_type <> 'view' THEN floor(value)::BIGINT::VARCHAR END AS signature, row_number() OVER (ORDER BY ts DESC, event_id) AS k FROM events WHERE ts >= {now} - INTERVAL {hours} HOUR AND value >= {least}),
 f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS incident, NULL::VARCHAR AS signature, false AS kept, []::BIGINT[] AS i, []::VARCHAR[] AS s UNION ALL SELECT e.k, e.id, e.incident, e.signature, NOT (list_contains(f.i, e.incident) OR coalesce(list_contains(f.s, e.signature), false)),
 CASE WHEN NOT (list_contains(f.i, e.incident) OR coalesce(list_contains(f.s, e.signature), false)) THEN list_append(f.i, e.incident) ELSE f.i END,
 CASE WHEN e.signature IS NOT NULL AND NOT (list_contains(f.i, e.incident) OR coalesce(list_contains(f.s, e.signature), false)) THEN list_append(f.s, e.signature) ELSE f.s END FROM f JOIN e ON e.k = f.k + 1)
 SELECT id, incident, signature FROM f WHERE kept ORDER BY k"""

ORACLE = {
    "recent_events": f"WITH {_R} SELECT {', '.join(views.COLUMNS)} FROM q WHERE ts >= {_NOW} - INTERVAL 24 HOUR AND NOT channel ILIKE 'test%' AND NOT is_fallback AND lat BETWEEN 46 AND 51 AND lon BETWEEN 24 AND 38 AND NOT (lat BETWEEN 48 AND 49.5 AND lon BETWEEN 28 AND 33) AND (event_type <> 'view' OR is_official OR regexp_matches(text, '1|3|7'))",
    "window_sizes": f"WITH {_R} SELECT h::INTEGER AS hours, count(id) AS n FROM (VALUES (-3), (0), (1), (24)) v(h) LEFT JOIN q ON h > 0 AND ts >= {_NOW} - h * INTERVAL 1 HOUR AND NOT channel ILIKE 'test%' AND NOT is_fallback AND event_type IN ('click', 'error', 'purchase') GROUP BY 1",
    "region_boxes": f"WITH b AS (SELECT lower(n_name) AS region, 44.0::DOUBLE + (n_nationkey % 5) * 1.5::DOUBLE AS south, 22.0::DOUBLE + n_nationkey * 3 % 16 AS west FROM nation), c AS (SELECT {_LAT.format('c_custkey')} AS lat, {_LON.format('c_custkey')} AS lon FROM customer) SELECT region, count(*) AS n FROM c JOIN b ON lat BETWEEN south AND south + 1.75::DOUBLE AND lon BETWEEN west AND west + 2.25::DOUBLE GROUP BY 1",
    "acceptance": f"SELECT CASE WHEN (doc_id % 31 = 0 OR trim(text) = '') AND doc_id % 62 <> 0 THEN 'empty' WHEN doc_id % 37 = 0 THEN 'invalid_json' WHEN doc_id % 41 = 0 THEN 'already_processed' WHEN {_ANY(DIGESTS)} AND doc_id % 31 <> 0 THEN 'civilian_noise' WHEN {_ANY(NOISE)} AND NOT {_ANY(STRONG)} AND doc_id % 31 <> 0 THEN 'civilian_noise' WHEN NOT {_ANY(WANTED)} OR doc_id % 31 = 0 THEN 'irrelevant' WHEN lang = 'fr' THEN 'outside' WHEN doc_id % 5 = 0 THEN 'not_confirmed' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1".replace(
        f"NOT {_ANY(WANTED)} OR doc_id % 31 = 0", f"NOT {_ANY(WANTED)}"
    ).replace(" AND doc_id % 31 <> 0 THEN", " THEN"),
    "context_order": "WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'capital' WHEN c_custkey % 2 = 0 THEN 'coast' WHEN c_custkey % 5 = 0 THEN 'coast' ELSE 'none' END AS context FROM customer) SELECT context, count(*) AS n FROM c GROUP BY 1",
    "duplicate_raise": f"WITH {_R}, d AS (SELECT channel, id % 40 AS message_id, min(id) AS x, arg_min(id, (ts, id)) AS id, count(*) AS n, max(significance) AS significance, max(confidence) AS confidence, arg_max(event_type, (ts, id)) AS event_type FROM q GROUP BY 1, 2) SELECT channel, message_id, id, n, significance, confidence, greatest(10, least(100, floor(0.55::DOUBLE * significance + 0.45::DOUBLE * confidence)))::INTEGER AS resonance, event_type FROM d",
    "rescored": f"WITH {_R}, s AS (SELECT event_type, resonance, greatest(15, least(100, CASE event_type WHEN 'error' THEN 80 WHEN 'purchase' THEN 60 WHEN 'signup' THEN 45 WHEN 'click' THEN 20 ELSE 30 END + CASE WHEN has_media THEN 5 ELSE 0 END)) AS sig, least(100, CASE WHEN is_official AND sources_count * 0.5 >= 2 THEN 95 WHEN is_official THEN 90 WHEN sources_count * 0.5 >= 1.5 THEN 85 WHEN sources_count * 0.5 >= 1.2 THEN 70 WHEN sources_count % 2 >= 1 THEN 60 ELSE 40 END + CASE WHEN has_media THEN 8 ELSE 0 END) AS conf FROM q), f AS (SELECT event_type, resonance, greatest(10, least(100, floor(0.55::DOUBLE * sig + 0.45::DOUBLE * conf))) AS fresh FROM s) SELECT event_type, sum(resonance)::BIGINT AS before, sum(fresh)::BIGINT AS after, count(*) FILTER (fresh > resonance) AS raised FROM f GROUP BY 1",
    "region_rewrite": "WITH e AS (SELECT event_type, value, user_id % 8 AS region, CASE WHEN event_id % 13 > 0 THEN 44.0::DOUBLE + (user_id * 7919 % 850) / 100.0::DOUBLE END AS lat FROM events WHERE NOT (event_type = 'view' AND value < 10)), r AS (SELECT region AS old, lat, CASE WHEN lat IS NULL OR lat BETWEEN 44.5::DOUBLE + region - 0.5 AND 44.5::DOUBLE + region + 0.5 THEN region ELSE floor(lat - 44)::BIGINT END AS region FROM e) SELECT region, count(*) AS n, count(*) FILTER (old <> region) AS moved, count(*) FILTER (lat IS NULL) AS filled, round(avg(coalesce(lat, 44.5::DOUBLE + old)), 3) AS lat FROM r GROUP BY 1",
    "thermal_top": f"SELECT event_id, value AS intensity, round(300.0::DOUBLE + value - 273.15::DOUBLE, 2) AS celsius FROM events WHERE event_type = 'error' AND value >= 15 AND ts <= {_NOW} - INTERVAL 3 HOUR ORDER BY value DESC, event_id LIMIT 5",
    "last_movements": "SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'place_' || user_id % 9 END AS origin, CASE WHEN user_id % 3 > 0 THEN 'place_' || user_id % 7 END AS goal FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
    "half_day_report": _UNSEEN.format(now=_NOW, hours=12, least=0) + " LIMIT 10",
    "hour_activity": _UNSEEN.format(now=_NOW, hours=1, least=5),
    "text_signatures": "WITH d AS (SELECT concat_ws(',', "
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in SIGNATURES)
    + ") AS rules FROM documents) SELECT rules, count(*) AS n FROM d GROUP BY 1",
    "alias_matches": f"SELECT CASE {_ALIAS} ELSE 'none' END AS place, count(*) AS n FROM documents GROUP BY 1",
    "channel_regions": "WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m FROM customer), f AS (SELECT k, m, CASE WHEN k % 4 < 2 THEN (SELECT count(*) FROM nation WHERE lower(n_name) = 'nation_' || (k % 30)) END AS own, CASE WHEN k % 4 = 0 THEN 'nation_' || (k % 30) WHEN k % 4 = 1 THEN 'live_nation_' || (k % 30) || '_now' WHEN k % 4 = 2 THEN lower('news ' || m) ELSE 'other' END AS ch FROM c), i AS (SELECT k, arg_max('region_' || n_regionkey, (length(n_name), lower(n_name))) AS inside FROM f JOIN nation ON contains(ch, lower(n_name)) GROUP BY 1), e AS (SELECT k, 'region_' || n_regionkey AS exact FROM f JOIN nation ON ch = lower(n_name)), s AS (SELECT f.k, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN inside IS NOT NULL THEN 'inside' WHEN regexp_matches(ch, 'automo|household|machinery') THEN 'stem' ELSE 'none' END AS how, coalesce(exact, inside, CASE WHEN contains(ch, 'automo') THEN 'autos' WHEN contains(ch, 'household') THEN 'homes' WHEN contains(ch, 'machinery') THEN 'works' END) AS region FROM f LEFT JOIN i ON i.k = f.k LEFT JOIN e ON e.k = f.k) SELECT how, region, count(*) AS n FROM s GROUP BY 1, 2",
    "located_texts": f"WITH {_LOCATED} SELECT kind, confidence, building, count(*) AS n, round(avg(lat), 3) AS lat FROM l GROUP BY 1, 2, 3",
    "street_addresses": f"SELECT {_STREET} AS street, count(*) AS n, count(*) AS with_building FROM customer WHERE c_custkey % 5 IN (1, 2) GROUP BY 1",
    "report_checks": f"WITH {_LOCATED}, w AS (SELECT id, min({_KM.format('l.lat', 'l.lon', 'o.lat', 'o.lon')}) AS km FROM l, (SELECT {_LAT.format('n_nationkey')} AS lat, {_LON.format('n_nationkey')} AS lon FROM nation) o WHERE l.lat IS NOT NULL GROUP BY 1), p AS (SELECT id, min({_KM.format('l.lat', 'l.lon', 'o.lat', 'o.lon')}) AS km FROM l, (SELECT {_LAT.format('s_suppkey')} AS lat, {_LON.format('s_suppkey')} AS lon FROM supplier) o WHERE l.lat IS NOT NULL GROUP BY 1), s AS (SELECT l.lat, CASE WHEN l.lat IS NULL THEN 25 ELSE least(100, 30 + CASE kind WHEN 'coordinate' THEN 25 WHEN 'address' THEN 20 ELSE 5 END + CASE WHEN w.km <= 5 THEN 35 WHEN w.km <= 15 THEN 20 ELSE 0 END + CASE WHEN p.km < 0.5 THEN 15 ELSE 0 END) END::INTEGER AS score, w.km <= 15 AS warned FROM l LEFT JOIN w USING (id) LEFT JOIN p USING (id)) SELECT CASE WHEN lat IS NULL THEN 'UNVERIFIED_PENDING' WHEN score >= 85 AND warned THEN 'CONFIRMED' WHEN score >= 65 THEN 'HIGH_PROBABILITY' WHEN score >= 40 THEN 'UNVERIFIED_PENDING' ELSE 'FALSE_ALARM' END AS status, score, count(*) AS n FROM s GROUP BY 1, 2",
    "nearest_sector": f"WITH s AS ({_SECTOR}), c AS (SELECT c_custkey, {_LAT.format('c_custkey')} AS lat, {_LON.format('c_custkey')} AS lon FROM customer), d AS (SELECT c_custkey, arg_min(sector, (pow(lat - slat, 2) + pow((lon - slon) * cos(radians(lat)), 2), sector)) AS sector FROM c, s GROUP BY 1) SELECT sector, count(*) AS n FROM d GROUP BY 1",
    "subscriptions": "WITH o AS (SELECT c_custkey AS subscriber, unnest(['d' || (c_custkey % 6), 'd' || (c_custkey * 5 % 7)]) AS d FROM customer), s AS (SELECT DISTINCT subscriber, tag FROM (SELECT subscriber, d AS tag FROM o UNION ALL SELECT subscriber, 'area' || substr(d, 2) FROM o WHERE d <> 'd6')), e AS (SELECT DISTINCT event_id, tag FROM (SELECT event_id, unnest(['area' || (user_id % 8), 'd' || (event_id % 9)]) AS tag FROM events WHERE event_type = 'error')), n AS (SELECT tag, count(*) AS n FROM e GROUP BY 1) SELECT subscriber, sum(n)::BIGINT AS mentions, count(*) AS tags FROM s JOIN n USING (tag) GROUP BY 1",
}
