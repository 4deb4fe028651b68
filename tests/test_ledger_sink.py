"""The incident table: any order of arrival, batches that come again or failed half way, changes that add up, and what is let go."""

import random

import pytest

from tests.test_ledger import BASE, SCHEMA
from tidewatch.operators import ledger
from tidewatch.streaming import ledger_sink, reports


def some(seed: int, n: int = 160):
    rnd, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rnd.choice([10.0, 200.0, 600.0, 4000.0])
        rows.append(
            BASE | {"id": i, "t": t, "region": rnd.randrange(2), "lat": rnd.choice([None, 50 + rnd.randrange(6) * 0.05]), "lon": 30 + rnd.randrange(4) * 0.05, "place": rnd.choice([None, "Mill", "Quay", "Old town"]), "channel": f"c{rnd.randrange(5)}",
                    "message": rnd.choice([None, i // 9]), "official": rnd.random() < 0.1, "media": rnd.random() < 0.2, "event_type": rnd.choice(list(ledger.RANKS)), "significance": rnd.randrange(100), "reliability": rnd.randrange(1, 7)}
        )
    for r in rows:
        r["rank"] = ledger.RANKS[r["event_type"]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[k] for k in BASE) for r in rows], SCHEMA)


def table(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed", [1])
def test_any_order_gives_the_batch_result(spark, tmp_path, seed):
    """Reports up to hours late, in batches that all come twice, some with rows of the batch before."""
    rows, rnd = some(seed), random.Random(seed)
    order = sorted(rows, key=lambda r: r["t"] + rnd.choice([0, 0, 3000, 20000]))
    batches = [order[i : i + 50] for i in range(0, len(order), 50)]
    sink, played = ledger_sink.IncidentTable(spark, f"{tmp_path}/t", 40_000.0, 60_000.0), {}
    for n, b in enumerate(batches):
        sent = frame(spark, b + (batches[n - 1][:5] if n else []))
        sink.merge(sent, n)
        before = table(sink.incidents())
        sink.merge(sent, n)
        assert table(sink.incidents()) == before
        for r in sorted(sink.changes(n).collect(), key=lambda r: r.change == "put"):
            if r.change == "retract":
                assert played.pop((r.region, r.incident))[1:] == tuple(r)[1:]
            else:
                assert (r.region, r.incident) not in played
                played[r.region, r.incident] = tuple(r)
    whole = ledger.merged(frame(spark, rows))
    assert table(sink.incidents()) == table(whole)
    assert {k: v[1:] for k, v in played.items()} == {(r.region, r.incident): tuple(r) for r in sink.incidents().select(*sink.changes(0).columns[1:]).collect()}


def test_a_failed_batch_is_done_over(spark, tmp_path, monkeypatch):
    rows = some(3, 80)
    sink = ledger_sink.IncidentTable(spark, f"{tmp_path}/t", 1e9)
    sink.merge(frame(spark, rows[:40]), 0)
    write = ledger_sink.IncidentTable._write
    monkeypatch.setattr(ledger_sink.IncidentTable, "_write", lambda self, df, what, v: write(self, df, what, v) if what != "reports" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sink.merge(frame(spark, rows[40:]), 1)
    monkeypatch.undo()
    assert sink.versions() == [0] and table(sink.incidents()) == table(ledger.merged(frame(spark, rows[:40])))
    sink.merge(frame(spark, rows[40:]), 1)
    assert table(sink.incidents()) == table(ledger.merged(frame(spark, rows)))


def test_old_reports_are_let_go_and_refused(spark, tmp_path):
    """Reports of groups that are over are not kept, their incidents are, and what comes too late is refused."""
    sink = ledger_sink.IncidentTable(spark, f"{tmp_path}/t", 1000.0, 0.0)
    day = lambda i, t: BASE | {"id": i, "t": t, "place": None, "lat": 50.0 + i}
    sink.merge(frame(spark, [day(i, 10_000.0 * i) for i in range(5)]), 7)
    assert sink.spark.read.parquet(f"{tmp_path}/t/reports/version=7").count() == 1
    sink.merge(frame(spark, [day(20, 100.0), day(21, 39_500.0), day(22, 41_000.0)]), 8)
    assert [r.id for r in sink.refused(8).collect()] == [20] and sink.incidents().count() == 7
    sink.merge(frame(spark, []), 9)
    assert sink.incidents().count() == 7 and sink.changes(9).count() == 0


def test_as_a_stream(spark, tmp_path):
    rows = some(4, 120)
    for i in range(3):
        frame(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = ledger_sink.IncidentTable(spark, f"{tmp_path}/t", 1e9)
    reports.merge_into(stream, sink.merge, f"{tmp_path}/checkpoint")
    assert len(sink.versions()) == 3 and table(sink.incidents()) == table(ledger.merged(frame(spark, rows)))
