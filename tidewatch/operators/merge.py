"""Positions merged from several facts, and the district that a place names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def districts(place, tokens: list[str]) -> F.Column:
    """First of ``tokens`` that a place text holds, or null."""
    out = F.lit(None).cast("string")
    for token in reversed(tokens):
        out = F.when(F.lower(place).contains(token), token).otherwise(out)
    return out


def fused(facts: DataFrame, key: str, least: float = 0.30) -> DataFrame:
    """Weighted centre of the facts (lat, lon, spread_m, confidence, reliability 1 to 6, credibility) of each ``key``, with how well they agree.

    A fact weighs its confidence over its squared spread (50 m at least); those below ``least`` do not count. Conflicts are facts of confidence above a half
    that lie farther from the centre than twice their spread. The grade is the best reliability as a letter and the best credibility.
    """
    use = facts.where(F.col("confidence") >= least).withColumn("_w", F.col("confidence") / F.pow(F.greatest("spread_m", F.lit(50.0)), F.lit(2.0)))
    mean = lambda c: F.sum(F.col("_w") * F.col(c)) / F.sum("_w")
    spread = F.sqrt(F.sum(F.col("_w") * F.pow("spread_m", F.lit(2.0))) / F.sum("_w"))
    centre = use.groupBy(key).agg(
        mean("lat").alias("clat"), mean("lon").alias("clon"), spread.alias("radius"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("trust"), F.max("reliability").alias("r"), F.min("credibility").alias("c")
    )
    off = F.hypot((F.col("lat") - F.col("clat")) * 111320.0, (F.col("lon") - F.col("clon")) * 111320.0 * F.cos(F.radians("clat")))
    conflicts = use.join(centre.select(key, "clat", "clon"), key).groupBy(key).agg(F.count_if((F.col("confidence") > 0.5) & (off > 2 * F.col("spread_m"))).alias("conflicts"))
    grade = F.concat(F.substring(F.lit("FEDCBA"), F.col("r").cast("int"), F.lit(1)), F.col("c").cast("string"), F.when(F.col("conflicts") > 0, "!").otherwise(""))
    out = centre.join(conflicts, key)
    return out.select(key, F.round("clat", 6).alias("lat"), F.round("clon", 6).alias("lon"), F.round("radius", 1).alias("radius_m"), F.col("n").alias("sources"), "conflicts", F.round("trust", 3).alias("confidence"), grade.alias("grade"))


def agreed(evidence: DataFrame, key: str, apart_m: float = 2000.0) -> DataFrame:
    """One position of each ``key`` from evidence (lat, lon, confidence, radius_m, source): the centre weighted by confidence over radius,
    or, where evidence lies farther than ``apart_m`` from it, the single one of most confidence with the wider radius and a conflict flag.
    """
    from tidewatch.functions.geo import haversine_km

    w = Window.partitionBy(key)
    e = evidence.withColumn("_w", F.col("confidence") * 1000 / F.greatest("radius_m", F.lit(10.0)))
    mean = lambda c: F.sum(F.col("_w") * F.col(c)) / F.sum("_w")
    best = F.max_by(F.struct("source", "lat", "lon", "confidence", "radius_m"), F.struct("confidence", -F.col("radius_m"), "source"))
    centre = e.groupBy(key).agg(mean("lat").alias("clat"), mean("lon").alias("clon"), F.avg("confidence").alias("c"), F.min("radius_m").alias("r"), best.alias("b"), F.count(F.lit(1)).alias("n"))
    far = e.join(centre.select(key, "clat", "clon"), key).groupBy(key).agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) * 1000).alias("off"))
    out, split, one = centre.join(far, key), F.col("off") > apart_m, F.col("n") == 1
    pick = lambda single, both: F.when(split | one, single).otherwise(both)
    return out.select(
        key, pick(F.col("b.source").cast("string"), F.lit("consensus")).alias("source"), F.round(pick(F.col("b.lat"), F.col("clat")), 5).alias("lat"), F.round(pick(F.col("b.lon"), F.col("clon")), 5).alias("lon"),
        F.round(pick(F.col("b.confidence"), F.least(F.lit(1.0), F.col("c") + 0.15)), 4).alias("confidence"),
        F.round(F.when(one, F.col("b.radius_m")).when(split, F.greatest(F.col("b.radius_m"), F.col("off"))).otherwise(F.greatest(F.lit(10.0), F.col("r") * 0.8)), 1).alias("radius_m"), split.alias("conflict"),
    )
