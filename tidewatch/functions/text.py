"""Clean-up, signatures, ordered rules and literals in report texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column, longest: int = 300, promotion: list[str] | None = None) -> Column:
    """Without tags, link targets, URLs, lines that begin with a promotional phrase and repeated white space, cut at ``longest`` characters."""
    out = F.regexp_replace(text, r"<[^>]*>", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"https?://[^ ]+", "")
    if promotion:
        out = F.regexp_replace(out, "(?im)^[ ]*(?:" + "|".join(re.escape(p) for p in promotion) + ").*$", "")
    return F.substring(F.trim(F.regexp_replace(out, r"[ \n\t\r]+", " ")), 1, longest)


def shown(text: Column, longest: int = 300, promotion: list[str] | None = None) -> Column:
    """``clean`` for a page: an ellipsis where it was cut, and the characters of markup escaped."""
    whole = clean(text, 1 << 30, promotion)
    cut = F.when(F.length(whole) > longest, F.concat(F.rtrim(F.substring(whole, 1, longest)), F.lit("…"))).otherwise(whole)
    return F.replace(F.replace(F.replace(cut, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def signature(text: Column, place: Column | None = None) -> Column:
    """Letters and digits, of any script, of the first 80 characters, 35 at most, after those of the place; null below 15 without the place."""
    only = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")
    s = F.substring(only(F.substring(text, 1, 80)), 1, 35)
    return F.when(F.length(s) >= 15, s if place is None else F.concat(F.coalesce(only(place), F.lit("")), F.lit(":"), s))


def handle(name: Column) -> Column:
    return F.lower(F.ltrim(F.trim(name), F.lit("@")))


def slug(text: Column, longest: int = 10) -> Column:
    """Letters and digits of any script in upper case."""
    return F.upper(F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""), 1, longest))


def incident_id(ts: Column, place: Column) -> Column:
    return F.concat(F.lit("INC-"), F.date_format(ts, "yyyyMMddHHmm"), F.lit("-"), slug(place))


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(t) for t in terms))


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first rule, by priority, one of whose terms is in ``text``."""
    out = None
    for name, terms in rules:
        hit = contains_any(text, terms)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def first_alias(text: Column, places: list[tuple[str, list[str]]]) -> Column:
    """Name of the first place, in the order given, one of whose aliases, or whose name, stands in ``text`` between boundaries."""
    edge, out = r"""[\s,.;:!?()«»"'-]""", None
    for name, aliases in places:
        each = "|".join(r"\s+".join(map(re.escape, a.lower().split())) for a in [name, *aliases])
        hit = F.lower(text).rlike(f"(?:^|{edge})(?:{each})(?:$|{edge})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def acceptance(text, has_media, broken, seen, digest, noise, strong, wanted, outside, confirmed) -> Column:
    """Why a report is not taken, or null: the first of seven reasons. Digests are always noise; strong terms override other noise."""
    return (
        F.when((F.coalesce(F.trim(text), F.lit("")) == "") & ~has_media, "empty")
        .when(broken, "invalid_json")
        .when(seen, "already_processed")
        .when(digest | (noise & ~strong), "civilian_noise")
        .when(~wanted, "irrelevant")
        .when(outside, "outside")
        .when(~confirmed, "not_confirmed")
    )


def decimal_point(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a literal such as ``50.4501, 30.5234``; null if there is none."""
    pattern = r"(-?[0-9]{1,2}\.[0-9]{3,8})[ ,;]+(-?[0-9]{1,3}\.[0-9]{3,8})"
    return tuple(F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
