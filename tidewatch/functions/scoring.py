"""Severity, trust and fusion scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_table(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def clamp(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def significance(kind: Column, table: dict[str, float], boost=0, default: float = 30) -> Column:
    return clamp(by_table(kind, table, default) + boost, 15, 100)


def confidence(n_sources, total_weight, n_official, n_monitors, is_official, has_photo) -> Column:
    """Ladder from the total weight of the sources, how many of them are official or monitors, and the report's own standing; no source gives 35."""
    ladder = (
        F.when((n_official >= 1) & (total_weight >= 2.0), 95)
        .when((n_official >= 1) | is_official, 90)
        .when(total_weight >= 1.5, 85)
        .when(total_weight >= 1.2, 70)
        .when(n_monitors >= 1, 60)
        .otherwise(40)
    )
    return F.when(n_sources <= 0, F.lit(35)).otherwise(clamp(ladder + F.when(has_photo, 8).otherwise(0), 15, 100))


def composite(significance_score, confidence_score) -> Column:
    return clamp(F.floor(0.55 * significance_score + 0.45 * confidence_score), 10, 100).cast("int")


def fact_confidence(reliability, credibility, reputation) -> Column:
    return F.bround(0.40 * reliability + 0.35 * (1 - credibility) + 0.25 * reputation, 3)


def confirmation_tier(score) -> Column:
    return F.when(score >= 85, "VERIFIED").when(score >= 60, "LIKELY").otherwise("UNCONFIRMED")


def decayed_ratio(ratio, age_seconds, tau_seconds) -> Column:
    """A likelihood ratio that fades to neutral."""
    return 1 + (ratio - 1) * F.exp(-age_seconds / tau_seconds)


def log_odds(p) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def probability(odds) -> Column:
    return 1 / (1 + F.exp(-clamp(odds, -30.0, 30.0)))


def safety_zones_m(severe_kind: Column, score) -> tuple[Column, Column, Column]:
    """Radii of the inner, middle and outer zone around an incident, wider for a severe kind or a score of 80 and more."""
    wide = severe_kind | (score >= 80)
    return tuple(F.when(wide, far).otherwise(near) for near, far in ((30, 60), (90, 180), (200, 450)))


def checked(kind: Column, located: Column, warning_km: Column, site_km: Column) -> tuple[Column, Column]:
    """Score and status of a report from the kind of its location, a warning near by (km) and a public site near by (km)."""
    by_kind = F.when(kind == "coordinate", 25).when(kind == "address", 20).when(kind == "settlement", 5).otherwise(0)
    warning = F.when(warning_km <= 5, 35).when(warning_km <= 15, 20).otherwise(0)
    score = F.when(located, clamp(F.lit(30) + by_kind + warning + F.when(site_km < 0.5, 15).otherwise(0), 10, 100)).otherwise(25)
    status = (
        F.when(~located, "UNVERIFIED_PENDING")
        .when((score >= 85) & (warning > 0), "CONFIRMED")
        .when(score >= 65, "HIGH_PROBABILITY")
        .when(score >= 40, "UNVERIFIED_PENDING")
        .otherwise("FALSE_ALARM")
    )
    return score, status


def shares(values: Column) -> Column:
    """Factors (name, weight) with each one's share of all absolute weights in percent, largest first, ties by name."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x["weight"]))
    each = F.transform(values, lambda x: F.struct((-F.abs(x["weight"])).alias("k"), x["name"].alias("name"), x["weight"].alias("weight")))
    return F.transform(F.array_sort(each), lambda x: F.struct(x["name"].alias("name"), F.round(F.try_divide(-x["k"] * 100, total), 2).alias("share")))
