"""The incident ledger and reputations over the events table, with the fold as a recursive query in SQL.

Positions, places, channels and messages are derived from the events' ids, as the tables have none; clock time is
sixteen times as dense, so that reports meet.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import lake, ledger, merge, quality

KINDS = (("error", "fire"), ("purchase", "explosion"), ("click", "air_defense"), ("signup", "general_alert"))
NAMES, TOKENS = ("North", "South", "Mill", "Quay"), ("north", "south", "mill")


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _reports(spark, sf):
    """Reports without reputations."""
    u, e = F.col("user_id"), F.col("event_id")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in KINDS for x in p)), F.col("event_type")), F.lit("radar_track"))
    place = F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (u % 4 + 1).cast("int")), F.lit(" district "), u % 6)
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 / 16
    rows = _table(spark, sf, "events").select(
        (u % 8).alias("region"), e.alias("id"), t.alias("t"), F.when(u % 5 > 0, u % 50 / 100.0 + e % 7 / 200.0).alias("lat"), (u * 7 % 50 / 100.0).alias("lon"), (e % 9 == 0).alias("fallback"), place.alias("place"),
        merge.districts(place, list(TOKENS)).alias("district"), F.concat(F.lit("n_"), u % 40).alias("channel"), F.floor(t / 300).alias("message"), F.col("props").alias("text"), kind.alias("event_type"),
        scoring.by_table(kind, ledger.RANKS, 0).cast("int").alias("rank"), (u % 11 == 0).alias("official"), (e % 4 == 0).alias("media"), (F.col("value") % 85 + 15).cast("int").alias("significance"),
        (u % 6 + 1).cast("int").alias("reliability"), (e % 6 + 1).cast("int").alias("credibility"), (F.lit(50.0) + u % 20 * 100.0).alias("radius_m"), (e % 6 == 0).alias("heat"), (e % 29 == 0).alias("recycled"),
        (e % 3 == 0).alias("reviewed"), (F.col("event_type") != "error").alias("confirmed"),
    )
    k = F.col("n_nationkey")
    kinds = F.when(F.col("n_regionkey") == 0, "official").when(F.col("n_regionkey") == 1, "monitor").otherwise("other")
    registry = _table(spark, sf, "nation").select(F.concat(F.lit("n_"), k).alias("channel"), (F.lit(0.3) + k % 7 / 10.0).alias("weight"), kinds.alias("kind"))
    return rows.join(registry, "channel", "left")


def _trusted(spark, sf):
    rows = _reports(spark, sf)
    return ledger.reputations(rows.drop("reviewed", "confirmed"), rows.where("reviewed").select("channel", "t", "confirmed"))


def reputation_as_of(spark, sf):
    """What each report's channel had earned by reviews up to it."""
    return _trusted(spark, sf).select("id", "channel", F.round("reputation", 6).alias("reputation"))


def incident_merge(spark, sf):
    """The write path: incidents with positions, trust, status, sources and codes as all their reports leave them."""
    out = ledger.with_codes(ledger.merged(_trusted(spark, sf)))
    rounded = [F.round(c, 6).alias(c) for c in ("lat", "lon", "first_t", "last_t")]
    return out.select(
        "region", "incident", "code", *rounded, "source", "message", "text", "event_type", "official", "media", "significance", "confidence", "resonance", "status", "conflicts", "n",
        F.array_join("sources", ",").alias("sources"),
    )


def incident_assets(spark, sf):
    """The nearest supplier within 6 km of incidents that harm, as text."""
    k = F.col("s_suppkey")
    assets = _table(spark, sf, "supplier").select(k.alias("asset_id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), (k % 50 / 100.0 + 0.003).alias("lat"), (k * 7 % 50 / 100.0).alias("lon"))
    return ledger.with_assets(ledger.merged(_trusted(spark, sf)), assets, 6.0).select("region", "incident", "asset")


def consensus_rate(spark, sf):
    """Share of incidents that two sources or more agree on, by region."""
    return quality.consensus(ledger.merged(_trusted(spark, sf)), "region")


def review_rates(spark, sf):
    """Share of a channel's reviewed reports that were confirmed."""
    decision = F.when(~F.col("reviewed"), "OPEN").when(F.col("confirmed"), "CONFIRMED_ANALYST").when(F.col("media"), "DISCARDED_NOISE").otherwise("REJECTED_ANALYST")
    return quality.review_hits(_reports(spark, sf).withColumn("decision", decision), "channel")


def rule_gates(spark, sf):
    """A rule for good documents, by its labels: what it should change, by language."""
    d, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    rule = (F.col("n_chars") >= 600) & ~F.col("text").rlike("[#$%&*|]")
    return quality.gates(d.join(labels, "doc_id").select("lang", rule.alias("predicted"), (F.col("quality") == 1).alias("expected")), "lang")


def edge_merge(spark, sf):
    """Forward edges of the first half of all reports with those of the second half merged in."""
    e = _table(spark, sf, "events")
    f = e.select("event_id", F.concat(F.lit(" @N_"), F.col("user_id") % 20).alias("source"), F.concat(F.lit("n_"), (F.col("user_id") * 3 + F.col("event_id")) % 20).alias("target"), F.col("event_id").alias("ts"), F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("text"))
    none = spark.createDataFrame([], "source string, target string, weight long, first_seen long, last_seen long, sample string")
    return lake.merge_edges(lake.merge_edges(none, f.where("event_id % 2 = 0")), f.where("event_id % 2 = 1"))


_REPORTS = f"""
base AS (
    SELECT user_id % 8 AS region, event_id AS id, epoch_us(ts) / 1000000 / 16 AS t, CASE WHEN user_id % 5 > 0 THEN user_id % 50 / 100.0::DOUBLE + event_id % 7 / 200.0::DOUBLE END AS lat, user_id * 7 % 50 / 100.0::DOUBLE AS lon,
        event_id % 9 = 0 AS fallback, ['{"', '".join(NAMES)}'][user_id % 4 + 1] || ' district ' || (user_id % 6) AS place, 'n_' || (user_id % 40) AS channel, floor(epoch_us(ts) / 1000000 / 16 / 300)::BIGINT AS message, props AS text,
        CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS)} ELSE 'radar_track' END AS etype, user_id % 11 = 0 AS official, event_id % 4 = 0 AS media, trunc(value % 85 + 15)::INTEGER AS sig,
        (user_id % 6 + 1)::INTEGER AS rel, (event_id % 6 + 1)::INTEGER AS cred, 50.0::DOUBLE + user_id % 20 * 100.0 AS radius, event_id % 6 = 0 AS heat, event_id % 29 = 0 AS recycled, event_id % 3 = 0 AS reviewed, event_type <> 'error' AS confirmed
    FROM events
),
latest AS (SELECT b.id, max(r.t) AS seen FROM base b JOIN base r ON r.channel = b.channel AND r.reviewed AND r.t <= b.t GROUP BY b.id),
earned AS (
    SELECT b.id, 2 + sum(CASE WHEN r.confirmed THEN pow(0.5, (seen - r.t) / 1814400) ELSE 0 END) AS a, 2 + sum(CASE WHEN r.confirmed THEN 0 ELSE pow(0.5, (seen - r.t) / 1814400) END) AS b
    FROM base b JOIN latest ON latest.id = b.id JOIN base r ON r.channel = b.channel AND r.reviewed AND r.t <= b.t GROUP BY b.id
),
reports AS (
    SELECT base.*, coalesce(0.3::DOUBLE + n_nationkey % 7 / 10.0::DOUBLE, 0.4::DOUBLE) AS weight, CASE WHEN n_regionkey = 0 THEN 'official' WHEN n_regionkey = 1 THEN 'monitor' ELSE 'other' END AS kind,
        coalesce(earned.a / (earned.a + earned.b), 0.5) AS rep, CASE {" ".join(f"WHEN lower(place) LIKE '%{x}%' THEN '{x}'" for x in TOKENS)} END AS district,
        CASE etype {" ".join(f"WHEN '{k}' THEN {v}" for k, v in ledger.RANKS.items())} ELSE 0 END AS rnk,
        row_number() OVER (PARTITION BY region ORDER BY t, base.id) AS k, row_number() OVER (PARTITION BY base.channel, message ORDER BY t, base.id) > 1 AS rpt
    FROM base LEFT JOIN earned ON earned.id = base.id LEFT JOIN nation ON base.channel = 'n_' || n_nationkey
)"""


def _ladder(w, o, m, official, media):
    return f"least(100, CASE WHEN {o} > 0 AND {w} >= 2.0 THEN 95 WHEN {o} > 0 OR {official} THEN 90 WHEN {w} >= 1.5 THEN 85 WHEN {w} >= 1.2 THEN 70 WHEN {m} > 0 THEN 60 ELSE 40 END + CASE WHEN {media} THEN 8 ELSE 0 END)::INTEGER"


def _composite(sig, conf):
    return f"greatest(10, least(100, floor(0.55::DOUBLE * {sig} + 0.45::DOUBLE * {conf})))::INTEGER"


def _fact(rep):
    return f"(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.40::DOUBLE * ((rel - 1) / 5.0::DOUBLE) + 0.35::DOUBLE * (1.0::DOUBLE - (cred - 1) / 5.0::DOUBLE) + 0.25::DOUBLE * {rep})) * 1000 + 0.5) / 1000)"


# Each field of an incident after a report: (type, of a new one, of a merged one); raising changes four of them.
_FIELDS = {
    "incident": ("BIGINT", "id", "m.incident"),
    "first_t": ("DOUBLE", "t", "m.first_t"),
    "last_t": ("DOUBLE", "t", "greatest(m.last_t, t)"),
    "lat": ("DOUBLE", "lat", "CASE WHEN fuse THEN floor(lat1 * 1000000 + 0.5) / 1000000 ELSE m.lat END"),
    "lon": ("DOUBLE", "lon", "CASE WHEN fuse THEN floor(lon1 * 1000000 + 0.5) / 1000000 ELSE m.lon END"),
    "fallback": ("BOOLEAN", "fallback", "m.fallback"),
    "place": ("VARCHAR", "place", "m.place"),
    "district": ("VARCHAR", "district", "m.district"),
    "source": ("VARCHAR", "channel", "CASE WHEN take THEN channel ELSE m.source END"),
    "message": ("BIGINT", "message", "CASE WHEN take THEN message ELSE m.message END"),
    "text": ("VARCHAR", "text", "CASE WHEN take OR (higher AND (NOT m.official OR official)) THEN text ELSE m.text END"),
    "rep": ("DOUBLE", "rep", "rep1"),
    "radius": ("DOUBLE", "radius", "m.radius"),
    "etype": ("VARCHAR", "etype", "CASE WHEN higher THEN etype ELSE m.etype END"),
    "rnk": ("INTEGER", "rnk", "CASE WHEN higher THEN rnk ELSE m.rnk END"),
    "official": ("BOOLEAN", "official", "official1"),
    "media": ("BOOLEAN", "media", "media1"),
    "sig": ("INTEGER", "sig", "greatest(m.sig, sig)"),
    "conf": ("INTEGER", "least(100, single + CASE WHEN heat THEN 25 ELSE 0 END)", "conf1"),
    "res": ("INTEGER", _composite("sig", "single"), _composite("greatest(m.sig, sig)", "conf0")),
    "status": (
        "VARCHAR",
        "CASE WHEN recycled THEN 'DISPUTED' WHEN official THEN 'OFFICIAL' WHEN heat OR single >= 80 THEN 'VERIFIED' ELSE 'UNVERIFIED_SINGLE_SOURCE' END",
        "CASE WHEN conf1 >= 85 THEN 'VERIFIED' WHEN official1 THEN 'OFFICIAL' WHEN fuse AND off > 0 THEN 'DISPUTED' ELSE m.status END",
    ),
    "conflicts": ("INTEGER", "0", "m.conflicts + CASE WHEN fuse THEN off ELSE 0 END"),
    "n": ("BIGINT", "1", "m.n + 1"),
    "sources": ("VARCHAR[]", "[channel]", "CASE WHEN known THEN m.sources ELSE list_append(m.sources, channel) END"),
    "w": ("DOUBLE", "weight", "w1"),
    "o": ("INTEGER", "(kind = 'official')::INTEGER", "o1"),
    "mo": ("INTEGER", "(kind = 'monitor')::INTEGER", "mo1"),
}
_RAISED = {"sig": "greatest(m.sig, sig)", "conf": "greatest(m.conf, single)", "res": _composite("greatest(m.sig, sig)", "greatest(m.conf, single)"), "etype": "etype", "rnk": "rnk"}
_TYPE = "STRUCT(" + ", ".join(f"{k} {t}" for k, (t, _, _) in _FIELDS.items()) + ")"
_AFTER = ", ".join(f"{k} := (CASE WHEN rpt THEN {_RAISED.get(k, f'm.{k}')} WHEN m IS NULL THEN {new} ELSE {old} END)::{t}" for k, (t, new, old) in _FIELDS.items())

_FOLD = rf"""WITH RECURSIVE {_REPORTS},
fold AS (
    SELECT DISTINCT region, 0::BIGINT AS k, CAST([] AS {_TYPE}[]) AS held, CAST(NULL AS {_TYPE}) AS cur FROM reports
    UNION ALL
    SELECT region, k, CASE WHEN cur IS NULL THEN live WHEN m IS NULL THEN list_append(live, cur) ELSE list_transform(live, lambda x: CASE WHEN x.incident = cur.incident THEN cur ELSE x END) END, cur
    FROM (SELECT *, CASE WHEN rpt AND m IS NULL THEN NULL ELSE struct_pack({_AFTER}) END AS cur
    FROM (SELECT *, CASE WHEN fuse THEN greatest(conf0, floor(100 * (floor((CASE WHEN fm >= 0.3 AND fr >= 0.3 THEN (fm + fr) / 2 WHEN fm >= 0.3 THEN fm ELSE fr END) * 1000 + 0.5) / 1000) + 0.5))::INTEGER ELSE conf0 END AS conf1,
        (CASE WHEN fm > 0.5 AND sqrt(pow((m.lat - lat1) * 111320.0, 2) + pow((m.lon - lon1) * (111320.0 * cos(radians(lat1))), 2)) > 2 * m.radius THEN 1 ELSE 0 END
            + CASE WHEN fr > 0.5 AND sqrt(pow((lat - lat1) * 111320.0, 2) + pow((lon - lon1) * (111320.0 * cos(radians(lat1))), 2)) > 2 * radius THEN 1 ELSE 0 END)::INTEGER AS off
    FROM (SELECT *, (m.lat * wm + lat * wr) / (wm + wr) AS lat1, (m.lon * wm + lon * wr) / (wm + wr) AS lon1,
        coalesce(sqrt(pow(m.lat - lat, 2) + pow(m.lon - lon, 2)) <= 0.08 AND (fm >= 0.3 OR fr >= 0.3), false) AS fuse, {_ladder("w1", "o1", "mo1", "official1", "media1")} AS conf0,
        greatest({_ladder("weight", "(kind = 'official')::INTEGER", "(kind = 'monitor')::INTEGER", "official", "media")}, floor(100 * fr + 0.5)::INTEGER) AS single
    FROM (SELECT *, CASE WHEN fm >= 0.3 THEN fm / pow(greatest(m.radius, 50.0), 2) ELSE 0 END AS wm, CASE WHEN fr >= 0.3 THEN fr / pow(greatest(radius, 50.0), 2) ELSE 0 END AS wr
    FROM (SELECT *, {_fact("rep1")} AS fm, {_fact("rep")} AS fr, m.w + CASE WHEN known THEN 0 ELSE weight END AS w1,
        m.o + CASE WHEN NOT known AND kind = 'official' THEN 1 ELSE 0 END AS o1, m.mo + CASE WHEN NOT known AND kind = 'monitor' THEN 1 ELSE 0 END AS mo1
    FROM (SELECT *, rnk > m.rnk AND NOT (m.official AND NOT official AND NOT media) AS higher, official AND NOT m.official AS take, CASE WHEN official AND NOT m.official THEN rep ELSE m.rep END AS rep1,
        list_contains(m.sources, channel) AS known, m.official OR official AS official1, m.media OR media AS media1
    FROM (SELECT * EXCLUDE (m0), CASE WHEN m0.district <> district AND NOT rpt THEN NULL ELSE m0 END AS m
    FROM (SELECT *, CASE WHEN rpt THEN list_filter(live, lambda x: x.source = channel AND x.message = message)[-1] ELSE coalesce(
            list_filter(live, lambda x: NOT x.fallback AND NOT fallback AND coalesce(sqrt(pow(x.lat - lat, 2) + pow(x.lon - lon, 2)) <= 0.08, false))[-1],
            list_filter(live, lambda x: x.place = place AND x.first_t >= t - 1500)[-1]) END AS m0
    FROM (SELECT r.*, list_filter(f.held, lambda x: x.first_t >= r.t - 1800) AS live FROM fold f JOIN reports r ON r.region = f.region AND r.k = f.k + 1)))))))))
),
ended AS (SELECT region, cur.incident AS incident, arg_max(cur, k) AS i FROM fold WHERE cur IS NOT NULL GROUP BY region, cur.incident),
late AS (
    SELECT e.region, e.incident, max(r.sig) AS sig, max(greatest({_ladder("r.weight", "(r.kind = 'official')::INTEGER", "(r.kind = 'monitor')::INTEGER", "r.official", "r.media")}, floor(100 * {_fact("rep")} + 0.5)::INTEGER)) AS single, arg_max(r.etype, r.k) AS etype
    FROM ended e JOIN reports r ON r.rpt AND r.region = e.region AND r.channel = e.i.source AND r.message = e.i.message AND r.t > e.i.first_t + 1800 GROUP BY e.region, e.incident
),
done AS (
    SELECT e.region, e.incident, e.i, greatest(e.i.sig, l.sig) AS significance, greatest(e.i.conf, l.single) AS confidence, coalesce(l.etype, e.i.etype) AS event_type, l.sig IS NOT NULL AS hit
    FROM ended e LEFT JOIN late l ON l.region = e.region AND l.incident = e.incident
)
"""

_MERGE_SQL = rf"""{_FOLD}
SELECT region, incident, 'INC-' || strftime(make_timestamp((i.first_t * 1000000)::BIGINT), '%Y%m%d%H%M') || '-' || upper(regexp_replace(i.place, '[^A-Za-z0-9]', '', 'g')[1:10]) AS code, round(i.lat, 6) AS lat, round(i.lon, 6) AS lon,
    round(i.first_t, 6) AS first_t, round(i.last_t, 6) AS last_t, i.source AS source, i.message AS message, i.text AS text, event_type, i.official AS official, i.media AS media, significance, confidence,
    CASE WHEN hit THEN {_composite("significance", "confidence")} ELSE i.res END AS resonance, i.status AS status, i.conflicts AS conflicts, i.n AS n, array_to_string(list_sort(i.sources), ',') AS sources
FROM done
"""

_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(i.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(i.lat)) * pow(sin(radians(i.lon - a.lon) / 2), 2))))"
_ASSETS_SQL = rf"""{_FOLD},
assets AS (SELECT s_suppkey AS asset_id, s_name AS name, s_suppkey % 50 / 100.0::DOUBLE + 0.003 AS lat, s_suppkey * 7 % 50 / 100.0::DOUBLE AS lon FROM supplier),
near AS (
    SELECT region, incident, name, asset_id, {_KM} AS km FROM done JOIN assets a ON abs(i.lat - a.lat) < 0.06 AND abs(i.lon - a.lon) < 0.06
    WHERE event_type IN ('{"', '".join(ledger.ASSET_TYPES)}') AND {_KM} <= 6
),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY region, incident ORDER BY km, asset_id) = 1)
SELECT region, incident, CASE WHEN name IS NOT NULL THEN 'supplier: ' || name || ' (' || floor(km * 1000)::BIGINT || ' m)' END AS asset FROM done LEFT JOIN best USING (region, incident)
"""

QUERIES = {f.__name__: f for f in (incident_merge, incident_assets, reputation_as_of, consensus_rate, review_rates, rule_gates, edge_merge)}
ORACLE = {
    "incident_merge": _MERGE_SQL,
    "incident_assets": _ASSETS_SQL,
    "reputation_as_of": f"WITH {_REPORTS} SELECT id, channel, round(rep, 6) AS reputation FROM reports",
    "consensus_rate": f"{_FOLD} SELECT region, count(*) AS incidents, count(*) FILTER (len(i.sources) >= 2) AS multi_source, count(*) FILTER (i.official) AS official, round(count(*) FILTER (len(i.sources) >= 2) * 100.0 / count(*), 1)::DOUBLE AS consensus_rate FROM done GROUP BY region",
    "review_rates": f"WITH {_REPORTS} SELECT channel, count(*) FILTER (reviewed AND confirmed) AS confirmed, count(*) FILTER (reviewed AND NOT confirmed) AS refuted, round(count(*) FILTER (reviewed AND confirmed) * 100.0 / nullif(count(*) FILTER (reviewed), 0), 1)::DOUBLE AS hit_rate FROM reports GROUP BY channel",
    "rule_gates": r"""
        WITH j AS (SELECT lang, n_chars >= 600 AND NOT regexp_matches(text, '[#$%&*|]') AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT lang, count(*) FILTER (s AND y) AS tp, count(*) FILTER (s AND NOT y) AS fp, count(*) FILTER (NOT s AND y) AS fn, count(*) FILTER (NOT s AND NOT y) AS tn FROM j GROUP BY lang),
        m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c)
        SELECT lang, tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1,
            CASE WHEN r < 0.85 AND p < 0.9 THEN 'widen,narrow' WHEN r < 0.85 THEN 'widen' WHEN p < 0.9 THEN 'narrow' ELSE 'pass' END AS advice FROM m""",
    "edge_merge": "WITH f AS (SELECT event_id, 'n_' || (user_id % 20) AS source, 'n_' || ((user_id * 3 + event_id) % 20) AS target, CASE WHEN event_id % 4 > 0 THEN substr(props, 1, 500) END AS text FROM events) SELECT source, target, count(*) AS weight, min(event_id) AS first_seen, max(event_id) AS last_seen, coalesce(arg_max(text, event_id) FILTER (event_id % 2 = 1 AND text IS NOT NULL), arg_max(text, event_id) FILTER (event_id % 2 = 0 AND text IS NOT NULL)) AS sample FROM f WHERE source <> target GROUP BY source, target",
}
