"""Assets that share positions, and the search of open incidents."""

from tidewatch.operators import ledger


def test_the_least_of_assets_at_one_position(spark, monkeypatch):
    seen = []
    join = ledger.within_km
    monkeypatch.setattr(ledger, "within_km", lambda left, right, km: seen.append(right.count()) or join(left, right, km))
    incidents = spark.createDataFrame([(1, 1, 50.0, 30.0, "fire"), (1, 2, 50.0, 30.0, "general_alert"), (1, 3, 60.0, 30.0, "fire")], "region long, incident long, lat double, lon double, event_type string")
    assets = spark.createDataFrame([(i, "supplier", f"s{i}", 50.001 + i % 2 * 0.001, 30.0) for i in range(2, 400)], "asset_id long, kind string, name string, lat double, lon double")
    got = {r.incident: r.asset for r in ledger.with_assets(incidents, assets, 1.2).collect()}
    assert seen == [2] and got == {1: "supplier: s2 (111 m)", 2: None, 3: None}


def test_cells_around_are_not_searched_beyond_the_own():
    """Many open incidents beside a report's cell, out of its reach, and a newer one in its own: only that one is measured."""
    led, looked = ledger.Ledger(), []

    class Watched(dict):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    cell = ledger.REACH
    led.open = Watched({i: {"lat": -0.99 * cell, "lon": 0.5 * cell, "district": None} for i in range(1000)} | {1000: {"lat": 0.5 * cell, "lon": 0.5 * cell, "district": None}})
    led.cells = {(-1, 0): list(range(1000)), (0, 0): [1000]}
    assert led.find({"lat": 0.5 * cell, "lon": 0.5 * cell, "fallback": False, "place": None, "district": None, "t": 0.0}) == 1000
    assert len(looked) < 10
