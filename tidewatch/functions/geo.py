"""Distances, bearings and regions as column expressions (degrees in, kilometres out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point, 0 to 360."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_between(a, b) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def destination(lat, lon, heading, km) -> tuple[Column, Column]:
    d, h, p = km / RADIUS_KM, F.radians(heading), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(h))
    east = F.radians(lon) + F.atan2(F.sin(h) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), F.degrees(east)


def planar_degrees(lat1, lon1, lat2, lon2) -> Column:
    return F.hypot(lat1 - lat2, lon1 - lon2)


def local_plane_km(lat0, lon0, lat, lon) -> tuple[Column, Column]:
    """East and north of a point in the tangent plane at the origin."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * RADIUS_KM, F.radians(lat - lat0) * RADIUS_KM


def in_box(lat, lon, south, west, north, east) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def valid_point(lat, lon, bounds: tuple[float, float, float, float] = (-90, -180, 90, 180), scope: tuple[float, float, float, float] | None = None) -> Column:
    """Reason why a coordinate pair (numbers or text) cannot be used, or ``ok``.

    ``bounds`` (south, west, north, east) are those of the whole area, ``scope`` those of the region a report claims.
    """
    a, b = (x.cast("string").try_cast("double") for x in (lat, lon))
    inside = in_box(a, b, *bounds)
    return (
        F.when(lat.isNull() | lon.isNull(), "missing")
        .when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), "not_numeric")
        .when(~inside & in_box(b, a, *bounds), "axes_swapped")
        .when(~inside, "out_of_range")
        .when(F.lit(False) if scope is None else ~in_box(a, b, *scope), "outside_scope")
        .otherwise("ok")
    )


def nearest_of(lat, lon, centres: list[tuple[str, float, float]]) -> Column:
    """Name of the nearest of a few fixed centres by squared degrees, longitudes shrunk by the cosine of the latitude; ties by name."""
    off = lambda a, b: F.pow(lat - a, F.lit(2.0)) + F.pow((lon - b) * F.cos(F.radians(lat)), F.lit(2.0))
    return F.array_min(F.array(*(F.struct(off(F.lit(a), F.lit(b)).alias("d"), F.lit(name).alias("name")) for name, a, b in centres)))["name"]


def wind_triangle(speed, heading, wind_speed, wind_from) -> tuple[Column, Column, Column]:
    """Ground speed, ground heading and drift in [-180, 180)."""
    to = F.radians(wind_from + 180.0)
    east = speed * F.sin(F.radians(heading)) + wind_speed * F.sin(to)
    north = speed * F.cos(F.radians(heading)) + wind_speed * F.cos(to)
    track = F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))
    return F.hypot(east, north), track, F.pmod(track - heading + 180.0, F.lit(360.0)) - 180.0


def speed_of_sound(celsius) -> Column:
    return 331.3 * F.sqrt(1 + celsius / 273.15)


def sound_delay_s(km, celsius) -> Column:
    """Seconds that sound takes for a distance."""
    return km * 1000 / speed_of_sound(celsius)


def arrival_minutes(km, speed_kmh, sigma_kmh) -> tuple[Column, Column, Column]:
    """Earliest, nominal and latest minutes, at speeds two sigmas apart (null where that speed is not positive)."""
    at = lambda v: F.when(v > 0, km / v * 60)
    return at(speed_kmh + 2 * sigma_kmh), at(speed_kmh), at(speed_kmh - 2 * sigma_kmh)
