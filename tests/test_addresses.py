"""Addresses as rows: several-word names, buildings, city and district of the text, offsets, edge cases."""

from tidewatch.operators import addresses

RULES = addresses.Rules(
    before={"street": ("street", "st."), "avenue": ("avenue", "av.")},
    after={"road": ("road", "highway")},
    cities=(("Old Port", "Old Port"), ("Riverton", "Riverton")),
    districts=(("mill", "Mill Hill", "Riverton"), ("quay", "Quayside", "Old Port")),
    city="Capital",
)

CASES = {
    "Smoke on street Saint Mary Ann, 12a, in Riverton": [("street Saint Mary Ann", "12a", None, "Riverton", "address")],
    "st. Green 5/2 and avenue Long Field near the mill": [("street Green", "5/2", "Mill Hill", "Riverton", "address"), ("avenue Long Field", None, "Mill Hill", "Riverton", "street")],
    "Cars on Riverton road at 40": [("Riverton road", "40", None, "Capital", "address")],
    "Old Port, quay: avenue Été 007": [("avenue Été", None, "Quayside", "Old Port", "street")],
    "the mill of Old Port, street X-Ray 3 B": [("street X-Ray", "3B", None, "Old Port", "address")],
    "avenue A " + "." * 30 + " 9": [("avenue A", None, None, "Capital", "street")],
    "streets of London": [],
    "street 12": [],
    "": [],
}


def test_rows(spark):
    df = spark.createDataFrame([*enumerate(CASES), (98, None)], "id long, text string")
    rows = addresses.address_rows(df, RULES).orderBy("id", "start").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.street, r.building, r.district, r.city, r.precision))
        assert r.text[r.start : r.end].strip() == r.raw and r.query.startswith(r.street) and r.query.endswith(r.city)
    assert [got.get(i, []) for i in range(len(CASES))] == list(CASES.values()) and 98 not in got


def test_without_rules_and_long_texts(spark):
    df = spark.createDataFrame([(1, "street Long " * 20_000), (2, "street One, 1\n" * 3000)], "id long, text string")
    assert addresses.address_rows(df, addresses.Rules(before={})).count() == 0
    assert addresses.address_rows(df.where("id = 2"), RULES).count() == 3000
    assert addresses.address_rows(df.where("id = 1"), RULES).count() >= 0


def test_reports_of_a_small_file_are_spread(spark):
    from pyspark.sql import functions as F

    from tidewatch.plans import place_queries
    from tests.conftest import SF

    at = place_queries._address_texts(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(at) == int(spark.conf.get("spark.sql.shuffle.partitions"))
