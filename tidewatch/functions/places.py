"""Addresses, coordinate literals and movement phrases in report texts, and the position of the sun."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import decimal_point

# Words before a street's name, and words after it.
PREFIXES = ["street", "avenue", "rue", "calle", "strasse", "square", "lane"]
SUFFIXES = ["street", "road"]

NAME = r"\p{L}+"
TAIL = 25


def addresses(text: Column) -> Column:
    """Array of (street, building) in order: street names after or before their word; the building is a number in the 25 characters that follow."""
    before, after = "|".join(PREFIXES), "|".join(SUFFIXES)
    pattern = rf"(?:^|[^\p{{L}}])((?:{before}) {NAME}|{NAME} (?:{after}))([^\n]{{0,{TAIL}}})"
    streets = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(streets, tails, lambda s, t: F.struct(s.alias("street"), F.nullif(F.regexp_extract(t, r"^[ ,]*([0-9]{1,4}[A-Za-z]?)", 1), F.lit("")).alias("building")))


def dms_point(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a literal such as ``50°27'00.5"N 30°31'24"E``; null if there is none."""
    half = r"([0-9]{1,3})°([0-9]{1,2})'([0-9]{1,2}(?:\.[0-9]+)?)\"([NSEW])"
    pattern = half + "[ ,]+" + half
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))

    def degrees(i: int) -> Column:
        size = part(i).cast("double") + part(i + 1).cast("double") / 60 + part(i + 2).cast("double") / 3600
        return F.when(part(i + 3).isin("S", "W"), -size).otherwise(size)

    return degrees(1), degrees(5)


def located(text: Column, cities: list[tuple[str, float, float]], bounds: tuple[float, float, float, float] = (44.0, 22.0, 53.0, 42.0)) -> Column:
    """The place a report text tells best, as (kind, street, building, lat, lon, confidence): decimal or sexagesimal coordinates within ``bounds``
    (0.98, 0.99), an address with a building (0.9 in a named city, 0.75 without), or a city alone (0.65); null fields if there is none."""
    in_text = lambda lat, lon: (lat.between(bounds[0], bounds[2]) & lon.between(bounds[1], bounds[3]))
    dd, dms = decimal_point(text), dms_point(text)
    city = F.filter(F.array(*(F.when(F.lower(text).contains(n), F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon"))) for n, a, b in cities)), lambda c: c.isNotNull())
    city = F.get(city, 0)
    full = F.get(F.filter(addresses(text), lambda a: a["building"].isNotNull() & (F.length(a["street"]) >= 5)), 0)

    def place(kind, street, building, lat, lon, confidence):
        values = (F.lit(kind), street, building, lat, lon, confidence)
        return F.struct(*(v.cast(t).alias(n) for v, (n, t) in zip(values, _LOCATED, strict=True)))

    none = F.lit(None)
    return (
        F.when(in_text(*dd), place("coordinate", none, none, *dd, F.lit(0.98)))
        .when(in_text(*dms), place("coordinate", none, none, *dms, F.lit(0.99)))
        .when(full.isNotNull(), place("address", full["street"], full["building"], city["lat"], city["lon"], F.when(city.isNotNull(), 0.90).otherwise(0.75)))
        .when(city.isNotNull(), place("settlement", none, none, city["lat"], city["lon"], F.lit(0.65)))
    )


_LOCATED = [("kind", "string"), ("street", "string"), ("building", "string"), ("lat", "double"), ("lon", "double"), ("confidence", "double")]


def movement(text: Column) -> tuple[Column, Column]:
    """Names of the places in ``from X toward Y``; null if there is no such phrase."""
    pattern = r"from ([^ ]+) towards? ([^ .,]+)"
    return tuple(F.nullif(F.regexp_extract(F.lower(text), pattern, i), F.lit("")) for i in (1, 2))


def walking_minutes(metres: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(metres / 80)).cast("int")


def sun(lat: Column, lon: Column, ts: Column) -> tuple[Column, Column, Column]:
    """Elevation of the sun in degrees (the almanac's Fourier series), shadow length per height (null at night), and azimuth from north."""
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    g = (F.dayofyear(ts) - 1 + (hour - 12) / 24) * (2 * math.pi / 365)
    series = lambda *terms: sum((k * f(g * n) for k, f, n in terms[1:]), F.lit(terms[0]))
    minutes = 229.18 * series(0.000075, (0.001868, F.cos, 1), (-0.032077, F.sin, 1), (-0.014615, F.cos, 2), (-0.040849, F.sin, 2))
    tilt = series(0.006918, (-0.399912, F.cos, 1), (0.070257, F.sin, 1), (-0.006758, F.cos, 2), (0.000907, F.sin, 2), (-0.002697, F.cos, 3), (0.00148, F.sin, 3))
    turn = F.radians((hour * 60 + minutes + 4 * lon) / 4 - 180)
    rise = F.sin(F.radians(lat)) * F.sin(tilt) + F.cos(F.radians(lat)) * F.cos(tilt) * F.cos(turn)
    elevation = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rise))))
    north = F.cos(F.radians(lat)) * F.sin(tilt) - F.sin(F.radians(lat)) * F.cos(tilt) * F.cos(turn)
    azimuth = F.pmod(F.degrees(F.atan2(-F.cos(tilt) * F.sin(turn), north)), F.lit(360.0))
    return elevation, F.when(elevation > 0, 1 / F.tan(F.radians(elevation))), azimuth
