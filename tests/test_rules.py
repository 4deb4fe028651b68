"""Rule tables read by one automaton against plain regular expressions, text by text."""

import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import rules

TABLES = rules.Tables(
    types=(("flood", ("flood", "water rose"), ()), ("fire", ("fire", "smoke"), ("house", "forest")), ("storm", ("storm", "wind"), ())),
    places=(("Harbour", "east", ("harbour", "port")), ("Mill Hill", "west", ("mill",)), ("Old Town", "west", ("old town",))),
    outside=(("north", ("northshire",)), ("south", ("southport",))),
    explicit=("this city",),
    noise=("road works",),
    guards=("street", "st."),
)

CASES = {
    "Flood in the harbour": ("flood", "east", "Harbour", True),
    "FIRE, then a flood": ("flood", None, None, True),
    "Smoke over the mill": (None, "west", "Mill Hill", False),
    "Smoke over the mill, a house burns": ("fire", "west", "Mill Hill", True),
    "smoke and wind": (None, None, None, False),
    "Storm on street Mill, by the old town": ("storm", "west", "Old Town", True),
    "Storm on st.  mill and at the mill": ("storm", None, None, True),
    "Storm at streetmill": ("storm", "west", "Mill Hill", True),
    "Storm in Southport": ("storm", "south", "Harbour", False),
    "Storm in Southport and in this city": ("storm", "east", "Harbour", True),
    "Storm in this city": ("storm", "home", None, True),
    "Road works, flood": (None, None, None, False),
    "nothing": (None, None, None, False),
    "": (None, None, None, False),
}


def test_cases(spark):
    df = spark.createDataFrame([*enumerate(CASES), (98, None)], "id long, text string")
    got = {r.id: (r.type, r.region, r.place, r.accepted) for r in rules.classified(df, TABLES).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values()) and got[98] == (None, None, None, False)


def plain(text):
    low = (text or "").lower()
    has = lambda terms: any(t in low for t in terms)
    kind = None
    if not has(TABLES.noise):
        for name, terms, causes in TABLES.types:
            if has(terms):
                kind = name if not causes or has(causes) else None
                break
    place = region = None
    for name, where, terms in TABLES.places:
        if any(t in low and not re.search(rf"(?:street|st\.)\s+{re.escape(t)}", low) for t in terms):
            place, region = name, where
            break
    outside = None if has(TABLES.explicit) else next((r for r, terms in TABLES.outside if has(terms)), None)
    return kind, outside or region or ("home" if has(TABLES.explicit) else None), place, bool(kind and not outside)


def test_against_regular_expressions(spark):
    import random

    rng = random.Random(5)
    parts = [*TABLES.terms(), "street ", "st. ", "st.\n", " ", " ", "x", "mi", "ll", "flo", "od", "é", "FIRE", "\n"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(9)))) for i in range(3000)] + [(3000, "old tow" * 50_000 + "n")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = {r.id: (r.type, r.region, r.place, r.accepted) for r in rules.classified(df, TABLES).collect()}
    assert got == {i: plain(t) for i, t in rows}
    assert len(set(got.values())) > 15


def test_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "flood", "was", "there")], "id long, text string, type string, `a.b` string")
    row = rules.classified(df, rules.Tables(types=())).first()
    assert (row.type, row.region, row.place, row.accepted, row["a.b"]) == (None, None, None, False, "there")
    assert rules.classified(df.where(F.lit(False)), TABLES).collect() == []
    with pytest.raises(ValueError):
        rules.Tables(types=(("x", ("",), ()),)).terms()
