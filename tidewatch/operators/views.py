"""Windowed views of report tables and membership in region boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo, text

#: The wide projection of a report view.
COLUMNS = (
    "id channel message_id text ts event_type lat lon significance confidence resonance incident_id stage has_media is_official sources_count status radius_m is_fallback".split()
)

Box = tuple[float, float, float, float]


def recent(reports: DataFrame, as_of, hours: float, box: Box | None = None, inner: Box | None = None, types: list[str] | None = None, generic: tuple[str, list[str]] | None = None) -> DataFrame:
    """Reports of the last ``hours`` before ``as_of``; none where the window is not positive.

    Channels whose name begins with "test" and fallback positions are left out. ``box`` and ``inner`` (south,
    west, north, east, inclusive) keep what is in the first and not in the second; ``types`` are those taken; unofficial
    reports of the ``generic`` type stay only with one of its keywords in their text.
    """
    if hours <= 0:
        return reports.limit(0)
    out = reports.where((F.col("ts") >= F.lit(as_of) - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(round(hours % 1 * 60)))) & ~F.lower("channel").startswith("test") & ~F.col("is_fallback"))
    lat, lon = F.col("lat"), F.col("lon")
    if box:
        out = out.where(geo.in_box(lat, lon, *box))
    if inner:
        out = out.where(~geo.in_box(lat, lon, *inner))
    if types is not None:
        out = out.where(F.col("event_type").isin(types))
    if generic:
        kind, words = generic
        out = out.where((F.col("event_type") != kind) | F.col("is_official") | text.contains_any(F.col("text"), words))
    return out


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``points`` (lat, lon, ...) with each ``region`` of ``boxes`` (region, south, west, north, east) they lie in, inclusive.

    Boxes are put in the whole degrees that they touch, so that an equi-join finds them.
    """
    cells = lambda low, high: F.sequence(F.floor(low), F.floor(high))
    dealt = boxes.withColumn("_row", F.explode(cells("south", "north"))).withColumn("_column", F.explode(cells("west", "east")))
    at = points.withColumns({"_row": F.floor("lat"), "_column": F.floor("lon")})
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return at.join(dealt, ["_row", "_column"]).where(inside).drop("_row", "_column", "south", "west", "north", "east")
