"""Place names resolved against a gazetteer, and membership and approach to regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import geo, text
from tidewatch.operators import spatial


def resolve(places: DataFrame, gazetteer: DataFrame, homonyms: DataFrame) -> DataFrame:
    """(id, key, how) of places (id, place, region): a homonym of the region, the exact name, or the longest name within the text; key is null otherwise.

    Each distinct text is resolved once. Names within a text are found by an equi-join on the text's
    substrings of the lengths that the gazetteer (key) has; homonyms are (name, region, key).
    """
    p = places.withColumn("_text", F.lower(F.trim("place")))
    lengths = sorted(r[0] for r in gazetteer.select(F.length("key")).where("key <> ''").distinct().collect())  # no more than the longest name has characters
    texts = p.select("_text").where(F.col("_text").isNotNull()).distinct()
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda i: F.substring(F.col("_text"), i, F.lit(n)))
    parts = F.concat(*(F.when(F.length("_text") >= n, at(n)).otherwise(F.array().cast("array<string>")) for n in lengths or [1]))
    best = F.max(F.struct(F.length("key").alias("n"), F.col("key"))).alias("m")
    found = texts.select("_text", F.explode(F.array_distinct(parts)).alias("key")).join(gazetteer.select("key"), "key").groupBy("_text").agg(best).select("_text", F.col("m.key").alias("_inside"))
    h = homonyms.select(F.col("name").alias("_text"), "region", F.col("key").alias("_homonym"))
    out = p.join(h, ["_text", "region"], "left").join(found, "_text", "left")
    how = F.when(F.col("_homonym").isNotNull(), "homonym").when(F.col("_inside") == F.col("_text"), "exact").when(F.col("_inside").isNotNull(), "inside").otherwise("unresolved")
    return out.select("id", F.coalesce("_homonym", "_inside").alias("key"), how.alias("how"))


def channel_regions(channels: DataFrame, registry: DataFrame, stems: list[tuple[str, str]]) -> DataFrame:
    """(id, region, how) of channels (id, channel): the registry's (name, region) for its own name, else for the longest registered name
    within it, else the first region whose stem (region, stem) it holds; null otherwise. Handles are compared without at sign and case."""
    own = channels.select("id", text.handle(F.col("channel")).alias("place"), F.lit("").alias("region"))
    found = resolve(own, registry.select(F.col("name").alias("key")), own.where("false").select(F.col("place").alias("name"), "region", F.col("place").alias("key")))
    stem = None
    for region, part in stems:
        hit = F.col("place").contains(part)
        stem = F.when(hit, region) if stem is None else stem.when(hit, region)
    known = found.join(registry.select(F.col("name").alias("key"), F.col("region").alias("_region")), "key", "left").select("id", "_region", "how")
    out = own.join(known, "id").withColumn("_stem", stem)
    how = F.when(F.col("_region").isNotNull(), F.col("how")).when(F.col("_stem").isNotNull(), "stem").otherwise("none")
    return out.select("id", F.coalesce("_region", "_stem").alias("region"), how.alias("how"))


def tagged(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, tags) of texts (id, text): the sorted districts one of whose alias words (alias, district) the text holds."""
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("alias"))
    hits = words.join(aliases.select("alias", "district"), "alias")
    return hits.groupBy("id").agg(F.sort_array(F.collect_set("district")).alias("tags"))


def approaching(points: DataFrame, regions: DataFrame, most_km: float = 160.0, close_km: float = 100.0, cone: float = 65.0) -> DataFrame:
    """(id, region, way, km, minutes) of moving points (id, lat, lon, heading, kmh) and regions (other_id, lat, lon, radius).

    ``direct`` within a region's radius; ``inbound`` farther off when within ``close_km``, or within
    ``most_km`` and headed there. Radii are at most ``most_km``. The minutes are to the region's centre, null if it does not move.
    """
    centres = regions.select("other_id", F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), "radius")
    near = spatial.within_km(points, regions, most_km).join(centres, "other_id")
    off = geo.angle_between(F.coalesce("heading", F.lit(0.0)), geo.bearing(F.col("lat"), F.col("lon"), F.col("_clat"), F.col("_clon")))
    way = F.when(F.col("km") <= F.col("radius"), "direct").when((off <= cone) | (F.col("km") <= close_km), "inbound")
    minutes = F.when(F.col("kmh") > 0, F.round(F.col("km") / F.col("kmh") * 60))
    return near.select("id", F.col("other_id").alias("region"), way.alias("way"), "km", minutes.alias("minutes")).where("way is not null")


def trail(points: DataFrame, key: str, order: list[str], n: int = 20) -> DataFrame:
    """The last ``n`` rows of each key, numbered from the newest in ``place``."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return points.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
