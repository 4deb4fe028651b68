"""Windowed analytics, scoring, text rules and incidents over the report-like tables.

``as_of`` is the newest timestamp of the table, never the wall clock. Where a table has no
positions they are derived from keys by a formula that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scoring, text
from tidewatch.operators import incidents, lake, release

# Fixed values of the synthetic rule tables.
SIGNIFICANCE = {"error": 80.0, "purchase": 60.0, "signup": 45.0, "click": 20.0}
RULES = [("credential", ["password", "token"]), ("licence", ["license", "copyright"]), ("contact", ["@", "http"])]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _as_of(df: DataFrame):
    return df.agg(F.max("ts")).first()[0]


def _seconds(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def recent_by_type(spark, sf):
    """Lookback window with test sources left out."""
    e = _events(spark, sf)
    recent = e.where((F.col("ts") >= F.lit(_as_of(e)) - F.expr("INTERVAL 24 HOURS")) & ~F.lower("event_type").startswith("test"))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("avg_value"))


def stats(spark, sf):
    """All-time and last-day counts and an average, in one pass."""
    e = _events(spark, sf)
    day = F.col("ts") >= F.lit(_as_of(e)) - F.expr("INTERVAL 24 HOURS")
    return e.agg(F.count(F.lit(1)).alias("total"), F.count_if(day).alias("last_day"), F.round(F.avg(F.when(day, F.col("value"))), 4).alias("avg_day"))


def top_sources(spark, sf):
    """The five sources with the most reports."""
    return _events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(5)


def spike(spark, sf):
    """Counts of 5, 15 and 60 minutes by type and a spike flag, in one scan."""
    e = _events(spark, sf)
    now = F.lit(_as_of(e))
    n = lambda m: F.count_if(F.col("ts") >= now - F.expr(f"INTERVAL {m} MINUTES"))
    out = e.groupBy("event_type").agg(n(5).alias("n5"), n(15).alias("n15"), n(60).alias("n60"))
    return out.withColumn("spike", (F.col("n60") > 0) & (F.col("n5") >= 3) & (F.col("n5") >= F.col("n60") / 12.0 * 2))


def hourly_pivot(spark, sf):
    """Hour by type, missing as 0."""
    types = ["click", "error", "purchase", "signup", "view"]
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour")
    return _events(spark, sf).groupBy(hour).pivot("event_type", types).agg(F.count(F.lit(1))).na.fill(0, types)


def local_hours(spark, sf):
    """Reports by the hour of the day in a local time zone, summer time included."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp") + F.make_interval(days=F.col("user_id").cast("int") * 2), "Europe/Kyiv")
    return _events(spark, sf).groupBy(F.hour(local).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def factor_shares(spark, sf):
    """Each kind's share of a source's evidence of the last day, largest first."""
    e = _events(spark, sf)
    age = F.unix_timestamp(F.lit(_as_of(e)).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    ratio = scoring.by_table(F.col("event_type"), {"error": 3.0, "purchase": 1.5, "click": 0.8}, 1.0)
    g = e.where(age <= 86400).groupBy("user_id", F.col("event_type").alias("name")).agg(F.sum(F.log(ratio)).alias("weight"))
    g = g.groupBy("user_id").agg(scoring.shares(F.collect_list(F.struct("name", "weight"))).alias("s"))  # a row per kind at most
    return g.select("user_id", F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["name"], F.round(x["share"]).cast("int"))), ",").alias("shares"))


def confusion(spark, sf):
    """Confusion matrix of a length rule against labels, with precision, recall and F1; null where nothing can be divided."""
    d = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id")
    says, is_ = F.col("n_chars") >= 800, F.col("quality") == 1
    g = d.agg(F.count_if(says & is_).alias("tp"), F.count_if(says & ~is_).alias("fp"), F.count_if(~says & is_).alias("fn"), F.count_if(~says & ~is_).alias("tn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


def gap_percentiles(spark, sf):
    """Gaps of at most 180 minutes between a source's reports: mean, upper median and p90 by index, clamped."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = _events(spark, sf).withColumn("gap", (_seconds() - F.lag(_seconds()).over(w)) / 60).where("gap <= 180")
    by = Window.partitionBy("user_id")
    g = g.withColumn("i", F.row_number().over(by.orderBy("gap")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    at = lambda k: F.max(F.when(F.col("i") == F.floor(F.col("n") * F.lit(k)), F.col("gap")))
    out = g.groupBy("user_id").agg(F.round(F.avg("gap"), 3).alias("mean_gap"), F.round(at(0.5), 3).alias("median_gap"), at(0.9).alias("p90"))
    return out.select("user_id", "mean_gap", "median_gap", F.round(scoring.clamp(F.col("p90"), 15.0, 60.0), 3).alias("p90_clamped"))


def burst(spark, sf):
    """Reports whose source sent three or more within the last hour, the report itself included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return _events(spark, sf).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 3").select("event_id", "user_id", "n")


def keep_last(spark, sf):
    """The last report of each source and type."""
    return lake.keep_last(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def top_reports(spark, sf):
    """The ten reports of the highest value, nulls last."""
    return _events(spark, sf).orderBy(F.desc_nulls_last("value"), "event_id").limit(10).select("event_id", "value")


def scores(spark, sf):
    """Severity, trust and their composite, with tiers and perimeters, by type."""
    e = _events(spark, sf)
    sig = scoring.significance(F.col("event_type"), SIGNIFICANCE, F.when(F.col("value") > 100, 10).otherwise(0))
    n, one = F.col("user_id") % 4, lambda test: F.when(test, 1).otherwise(0)
    conf = scoring.confidence(n, n * (F.col("user_id") % 10) / 10.0, one(F.col("event_type") == "signup"), one(F.col("user_id") % 3 == 0), F.lit(False), F.col("user_id") % 2 == 0)
    s = e.select("event_type", sig.alias("sig"), conf.alias("conf")).withColumn("comp", scoring.composite(F.col("sig"), F.col("conf")))
    s = s.withColumn("tier", scoring.confirmation_tier(F.col("conf")))
    return s.groupBy("event_type", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("sig").alias("sum_sig"), F.sum("conf").cast("long").alias("sum_conf"), F.sum("comp").cast("long").alias("sum_comp"))


def reputation(spark, sf):
    """Beta reputation of sources at their last report: errors count against, purchases for, with a half-life of 21 days."""
    e = _events(spark, sf).where(F.col("event_type").isin("error", "purchase")).withColumn("t", _seconds())
    e = e.withColumn("last", F.max("t").over(Window.partitionBy("user_id")))
    weight = F.pow(F.lit(0.5), (F.col("last") - F.col("t")) / (21 * 86400.0))
    side = lambda kind: 2 + F.sum(F.when(F.col("event_type") == kind, weight).otherwise(0.0))
    g = e.groupBy("user_id").agg(side("purchase").alias("a"), side("error").alias("b"))
    return g.select("user_id", F.round("a", 4).alias("alpha"), F.round("b", 4).alias("beta"), F.round(F.col("a") / (F.col("a") + F.col("b")), 4).alias("reputation"))


def evidence_fusion(spark, sf):
    """Log-odds of a source from its reports of the last day, fading with age, and the strongest kind's share."""
    e = _events(spark, sf)
    age = F.unix_timestamp(F.lit(_as_of(e)).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    ratio = scoring.by_table(F.col("event_type"), {"error": 3.0, "purchase": 1.5, "click": 0.8}, 1.0)
    r = e.where((age <= 86400)).select("user_id", F.log(scoring.decayed_ratio(ratio, age, F.lit(7200.0))).alias("l"))
    g = r.groupBy("user_id").agg(F.sum("l").alias("s"), F.sum(F.abs("l")).alias("size"), F.max(F.abs("l")).alias("most"))
    return g.select("user_id", F.round(scoring.probability(F.lit(-1.0) + F.col("s")), 4).alias("p"), F.round(F.when(F.col("size") > 0, F.col("most") / F.col("size") * 100), 2).alias("top_share"))


def release_view(spark, sf):
    """What may be published: errors held back 3 hours, positions coarsened by a keyed jitter, released ones left out, the newest 5,000 first."""
    e = _events(spark, sf)
    u = F.col("user_id")
    rows = e.select(
        F.col("event_id").alias("id"), "ts", (F.lit(44.0) + u % 850 / 100.0).alias("lat"), (F.lit(22.0) + u * 7 % 1800 / 100.0).alias("lon"), F.col("value").alias("confidence"),
        (F.col("event_type") == "error").alias("held"), (u % 8).alias("region"), "event_type",
    )
    out = release.released(rows, e.where("event_id % 10 = 0").select(F.col("event_id").alias("id")), _as_of(e), salt="a key of the caller", batch=5000)
    return out.select("id", "rough_lat", "rough_lng", "level", "status", "region", "summary")


def lake_upsert(spark, sf):
    """Two overlapping batches merged by id, by day."""
    e = _events(spark, sf)
    fresh = e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1000)
    merged = lake.upsert(e.where("event_id % 2 = 0"), fresh, "event_id", ["ts"])
    return merged.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("sum_value"))


def retention(spark, sf):
    """What a prune leaves, by stage."""
    e = _events(spark, sf)
    rows = e.select("ts", (F.col("value") % 100).alias("significance"), (F.col("event_type") == "error").alias("physical"), F.lit("OPEN").alias("stage"))
    return lake.retained(rows, _as_of(e)).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def alert_changes(spark, sf):
    """Changes of a region's state: errors raise it, purchases clear it, nothing else says anything."""
    e = _events(spark, sf).withColumn("region", F.col("user_id") % 8)
    state = F.when(F.col("event_type") == "error", "ACTIVE").when(F.col("event_type") == "purchase", "CLEAR")
    w = Window.partitionBy("region").orderBy("ts", "event_id")
    s = e.withColumn("state", state).where("state is not null").withColumn("before", F.coalesce(F.lag("state").over(w), F.lit("UNKNOWN")))
    return s.where("state <> before").select("region", "event_id", "before", "state")


def incident_fold(spark, sf):
    """Anchored incidents by region over time alone."""
    e = _events(spark, sf)
    nowhere = F.lit(None).cast("double")
    rows = e.select((F.col("user_id") % 8).alias("region"), F.col("event_id").alias("id"), _seconds().alias("t"), nowhere.alias("lat"), nowhere.alias("lon"), F.lit("here").alias("place"))
    return incidents.cluster(rows).groupBy("region", "incident").agg(F.count(F.lit(1)).alias("n"))


def incident_fold_spatial(spark, sf):
    """Anchored incidents by region, place and time."""
    e = _events(spark, sf)
    lat, lon = F.col("user_id") % 50 / 100.0, F.col("user_id") * 7 % 50 / 100.0
    rows = e.select((F.col("user_id") % 8).alias("region"), F.col("event_id").alias("id"), _seconds().alias("t"), lat.alias("lat"), lon.alias("lon"), F.lit(None).cast("string").alias("place"))
    return incidents.cluster(rows).groupBy("region", "incident").agg(F.count(F.lit(1)).alias("n"))


def text_clean(spark, sf):
    """Cleaned excerpts and signatures of all documents."""
    d = _table(spark, sf, "documents")
    return d.select("doc_id", F.length(text.clean(F.col("text"))).alias("clean_chars"), text.signature(F.col("text")).alias("sig"))


def text_rules(spark, sf):
    """First matching rule, by priority, of every document."""
    d = _table(spark, sf, "documents")
    return d.groupBy(text.first_match(F.col("text"), RULES, "other").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def quality_sweep(spark, sf):
    """Precision, recall and F1 of a length rule against labels over thresholds."""
    d = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id").select("n_chars", "quality")
    t = d.withColumn("threshold", F.explode(F.sequence(F.lit(200), F.lit(2000), F.lit(200))))
    says, is_ = F.col("n_chars") >= F.col("threshold"), F.col("quality") == 1
    g = t.groupBy("threshold").agg(F.count_if(says & is_).alias("tp"), F.count_if(says & ~is_).alias("fp"), F.count_if(~says & is_).alias("fn"))
    return g.withColumn("f1", F.round(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), 4))


def health(spark, sf):
    """Newest report of every type against the newest of all."""
    e = _events(spark, sf)
    now = F.lit(_as_of(e)).cast("timestamp")
    g = e.groupBy("event_type").agg(F.max("ts").alias("newest"))
    return g.select("event_type", (F.unix_timestamp(now) - F.unix_timestamp(F.col("newest").cast("timestamp"))).alias("age_s"))


QUERIES = {f.__name__: f for f in (
    recent_by_type, stats, top_sources, spike, hourly_pivot, local_hours, factor_shares, confusion, gap_percentiles, burst, keep_last, top_reports, scores, reputation, evidence_fusion, release_view,
    lake_upsert, retention, alert_changes, incident_fold, incident_fold_spatial, text_clean, text_rules, quality_sweep, health,
)}

_NOW = "(SELECT max(ts) FROM events)"
_SIG = "CASE event_type WHEN 'error' THEN 80.0 WHEN 'purchase' THEN 60.0 WHEN 'signup' THEN 45.0 WHEN 'click' THEN 20.0 ELSE 30.0 END + CASE WHEN value > 100 THEN 10 ELSE 0 END"

ORACLE = {
    "local_hours": "SELECT hour(timezone('Europe/Kyiv', timezone('UTC', ts + (user_id * 2) * INTERVAL 1 DAY)))::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1",
    "factor_shares": f"WITH e AS (SELECT user_id, event_type, ln(CASE event_type WHEN 'error' THEN 3.0::DOUBLE WHEN 'purchase' THEN 1.5::DOUBLE WHEN 'click' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) AS w FROM events WHERE floor(epoch({_NOW})) - floor(epoch(ts)) <= 86400), g AS (SELECT user_id, event_type, sum(w) AS w FROM e GROUP BY 1, 2), s AS (SELECT *, sum(abs(w)) OVER (PARTITION BY user_id) AS total FROM g) SELECT user_id, string_agg(concat_ws('=', event_type, CASE WHEN total > 0 THEN round(round(abs(w) * 100 / total, 2))::INTEGER END), ',' ORDER BY abs(w) DESC, event_type) AS shares FROM s GROUP BY 1",
    "confusion": "WITH g AS (SELECT count(*) FILTER (n_chars >= 800 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 800 AND quality <> 1) AS fp, count(*) FILTER (n_chars < 800 AND quality = 1) AS fn, count(*) FILTER (n_chars < 800 AND quality <> 1) AS tn FROM documents JOIN labels USING (doc_id)), p AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM g) SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / nullif(p + r, 0), 4) AS f1 FROM p",
    "recent_by_type": f"SELECT event_type, count(*) AS n, round(coalesce(avg(value), 0.0), 4) AS avg_value FROM events WHERE ts >= {_NOW} - INTERVAL 24 HOUR AND NOT event_type ILIKE 'test%' GROUP BY event_type",
    "stats": f"SELECT count(*) AS total, count(*) FILTER (ts >= {_NOW} - INTERVAL 24 HOUR) AS last_day, round(avg(value) FILTER (ts >= {_NOW} - INTERVAL 24 HOUR), 4) AS avg_day FROM events",
    "top_sources": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5",
    "spike": f"SELECT *, (n60 > 0 AND n5 >= 3 AND n5 >= n60 / 12.0 * 2) AS spike FROM (SELECT event_type, count(*) FILTER (ts >= {_NOW} - INTERVAL 5 MINUTE) AS n5, count(*) FILTER (ts >= {_NOW} - INTERVAL 15 MINUTE) AS n15, count(*) FILTER (ts >= {_NOW} - INTERVAL 60 MINUTE) AS n60 FROM events GROUP BY event_type)",
    "hourly_pivot": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY 1",
    "gap_percentiles": "WITH g AS (SELECT user_id, epoch_us(ts) / 1000000.0 / 60 - lag(epoch_us(ts) / 1000000.0 / 60) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap <= 180) SELECT user_id, round(avg(gap), 3) AS mean_gap, round(max(gap) FILTER (i = floor(n * 0.5)), 3) AS median_gap, round(greatest(15.0, least(60.0, max(gap) FILTER (i = floor(n * 0.9)))), 3) AS p90_clamped FROM r GROUP BY user_id",
    "burst": "SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3",
    "keep_last": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "top_reports": "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10",
    "scores": f"WITH s AS (SELECT event_type, greatest(15, least(100, {_SIG}))::DOUBLE AS sig, user_id % 4 AS k, (user_id % 4) * (user_id % 10) / 10.0 AS w, event_type = 'signup' AS o, user_id % 3 = 0 AS m, user_id % 2 = 0 AS p FROM events), c AS (SELECT event_type, sig, CASE WHEN k <= 0 THEN 35 ELSE least(100, CASE WHEN o AND w >= 2.0 THEN 95 WHEN o THEN 90 WHEN w >= 1.5 THEN 85 WHEN w >= 1.2 THEN 70 WHEN m THEN 60 ELSE 40 END + CASE WHEN p THEN 8 ELSE 0 END) END AS conf FROM s) SELECT event_type, CASE WHEN conf >= 85 THEN 'VERIFIED' WHEN conf >= 60 THEN 'LIKELY' ELSE 'UNCONFIRMED' END AS tier, count(*) AS n, sum(sig) AS sum_sig, sum(conf)::BIGINT AS sum_conf, sum(greatest(10, least(100, floor(0.55::DOUBLE * sig + 0.45::DOUBLE * conf))))::BIGINT AS sum_comp FROM c GROUP BY 1, 2",
    "reputation": "WITH e AS (SELECT user_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events WHERE event_type IN ('error', 'purchase')), w AS (SELECT user_id, event_type, pow(0.5::DOUBLE, (max(t) OVER (PARTITION BY user_id) - t) / 1814400.0::DOUBLE) AS w FROM e), g AS (SELECT user_id, 2 + sum(CASE WHEN event_type = 'purchase' THEN w ELSE 0 END) AS a, 2 + sum(CASE WHEN event_type = 'error' THEN w ELSE 0 END) AS b FROM w GROUP BY user_id) SELECT user_id, round(a, 4) AS alpha, round(b, 4) AS beta, round(a / (a + b), 4) AS reputation FROM g",
    "evidence_fusion": f"WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 3.0::DOUBLE WHEN 'purchase' THEN 1.5::DOUBLE WHEN 'click' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS r, floor(epoch({_NOW})) - floor(epoch(ts)) AS age FROM events), l AS (SELECT user_id, ln(1 + (r - 1) * exp(-age / 7200.0::DOUBLE)) AS l FROM e WHERE age <= 86400), g AS (SELECT user_id, sum(l) AS s, sum(abs(l)) AS size, max(abs(l)) AS most FROM l GROUP BY user_id) SELECT user_id, round(1 / (1 + exp(-greatest(-30.0, least(30.0, -1.0 + s)))), 4) AS p, round(CASE WHEN size > 0 THEN most / size * 100 END, 2) AS top_share FROM g",
    "release_view": f"WITH e AS (SELECT event_id AS id, ts, user_id, value, event_type, ('0x' || substr(sha256('a key of the caller:' || event_id::VARCHAR), 1, 8))::BIGINT AS h FROM events WHERE (event_type <> 'error' OR ts <= {_NOW} - INTERVAL 3 HOUR) AND event_id % 10 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 5000) SELECT id, floor((44.0::DOUBLE + (user_id % 850) / 100.0::DOUBLE + ((h % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 0.04::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS rough_lat, floor((22.0::DOUBLE + (user_id * 7 % 1800) / 100.0::DOUBLE + (((h >> 10) % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 0.04::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS rough_lng, CASE WHEN value >= 80 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN value >= 80 THEN 'CONFIRMED' ELSE 'PRELIMINARY' END AS status, user_id % 8 AS region, event_type || ' reported in region ' || (user_id % 8) AS summary FROM e",
    "lake_upsert": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(CASE WHEN event_id % 3 = 0 THEN value + 1000 ELSE value END), 2) AS sum_value FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY 1",
    "retention": f"SELECT CASE WHEN {_NOW} - ts > INTERVAL 90 DAY THEN 'ARCHIVED' ELSE 'OPEN' END AS stage, count(*) AS n FROM events WHERE NOT (value % 100 < 40 AND event_type <> 'error' AND {_NOW} - ts > INTERVAL 24 HOUR) GROUP BY 1",
    "alert_changes": "SELECT region, event_id, before, state FROM (SELECT user_id % 8 AS region, event_id, state, coalesce(lag(state) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id), 'UNKNOWN') AS before FROM (SELECT *, CASE event_type WHEN 'error' THEN 'ACTIVE' WHEN 'purchase' THEN 'CLEAR' END AS state FROM events) WHERE state IS NOT NULL) WHERE state <> before",
    "incident_fold": "WITH RECURSIVE e AS (SELECT user_id % 8 AS region, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS k FROM events), f AS (SELECT region, k, id AS incident, t AS anchor FROM e WHERE k = 1 UNION ALL SELECT e.region, e.k, CASE WHEN e.t - f.anchor <= 1500000000 THEN f.incident ELSE e.id END, CASE WHEN e.t - f.anchor <= 1500000000 THEN f.anchor ELSE e.t END FROM f JOIN e ON e.region = f.region AND e.k = f.k + 1) SELECT region, incident, count(*) AS n FROM f GROUP BY region, incident",
    "text_clean": r"SELECT doc_id, length(substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://[^ ]+', '', 'g'), '[ \n\t\r]+', ' ', 'g')), 1, 300))::INTEGER AS clean_chars, CASE WHEN length(substr(regexp_replace(lower(substr(text, 1, 80)), '[^\p{L}\p{N}]', '', 'g'), 1, 35)) >= 15 THEN substr(regexp_replace(lower(substr(text, 1, 80)), '[^\p{L}\p{N}]', '', 'g'), 1, 35) END AS sig FROM documents",
    "text_rules": "SELECT CASE WHEN regexp_matches(lower(text), 'password|token') THEN 'credential' WHEN regexp_matches(lower(text), 'license|copyright') THEN 'licence' WHEN regexp_matches(lower(text), '@|http') THEN 'contact' ELSE 'other' END AS rule, count(*) AS n FROM documents GROUP BY 1",
    "quality_sweep": "WITH t AS (SELECT n_chars, quality, unnest(generate_series(200, 2000, 200))::INTEGER AS threshold FROM documents JOIN labels USING (doc_id)), g AS (SELECT threshold, count(*) FILTER (n_chars >= threshold AND quality = 1) AS tp, count(*) FILTER (n_chars >= threshold AND quality <> 1) AS fp, count(*) FILTER (n_chars < threshold AND quality = 1) AS fn FROM t GROUP BY threshold) SELECT *, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM g",
    "health": f"SELECT event_type, (floor(epoch({_NOW})) - floor(epoch(max(ts))))::BIGINT AS age_s FROM events GROUP BY event_type",
}
