"""How good incidents, reviews and rules are; rates are null where there is nothing to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least recall and precision of a rule, decisions of reviewers.
LEAST_RECALL, LEAST_PRECISION = 0.85, 0.90
CONFIRMED, REFUTED = ("CONFIRMED_ANALYST",), ("REJECTED_ANALYST", "DISCARDED_NOISE")


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), 1)


def consensus(incidents: DataFrame, *by: str) -> DataFrame:
    """Incidents, those of two sources or more and official ones, and the share of the former in percent, of ``incidents`` (sources, official)."""
    n, many = F.count(F.lit(1)), F.count_if(F.size("sources") >= 2)
    return incidents.groupBy(*by).agg(n.alias("incidents"), many.alias("multi_source"), F.count_if("official").alias("official"), _percent(many, n).alias("consensus_rate"))


def review_hits(reviews: DataFrame, *by: str) -> DataFrame:
    """Confirmed and refuted ``reviews`` (decision), and the share of the former in percent; other decisions count as neither."""
    yes, no = F.count_if(F.col("decision").isin(*CONFIRMED)), F.count_if(F.col("decision").isin(*REFUTED))
    return reviews.groupBy(*by).agg(yes.alias("confirmed"), no.alias("refuted"), _percent(yes, yes + no).alias("hit_rate"))


def gates(judged: DataFrame, *by: str, recall: float = LEAST_RECALL, precision: float = LEAST_PRECISION) -> DataFrame:
    """Confusion counts of ``judged`` (expected, predicted booleans; a null prediction is false, a row without expectation does not count),
    precision, recall and F1, and what a rule should change: ``widen`` below the least recall, ``narrow`` below the least precision, both, or ``pass``.
    """
    yes, said = F.col("expected"), F.coalesce("predicted", F.lit(False))
    g = judged.where("expected is not null").groupBy(*by).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fp"))), zero(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fn")))
    g = g.withColumns({"precision": p, "recall": r})
    p, r = F.col("precision"), F.col("recall")
    advice = F.array_join(F.array_compact(F.array(F.when(r < recall, "widen"), F.when(p < precision, "narrow"))), ",")
    return g.select(*by, "tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(zero(F.try_divide(2 * p * r, p + r)), 4).alias("f1"), F.when(advice == "", "pass").otherwise(advice).alias("advice"))
