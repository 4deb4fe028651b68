"""Keyed, ordered state over streams: reports wait until the watermark has passed their minute, then are folded in the order of (t, id).

Waiting rows are entries of a map, each written and removed once, and a minute has one timer, so the work grows with the rows. What a key holds is written as one
small JSON value and expires: a timer at the event time of the last report plus its lifetime clears it. Late rows are dropped by the watermark, so a stream gives
what a batch gives for the rows that were in time. Rows of one key with equal t and id are one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.incidents import TEXT_WINDOW_S, WINDOW_S, Fold


MINUTE_US = 60_000_000


class Ordered(StatefulProcessor):
    """Rows (t microseconds, id, ...) of a key in event-time order through ``step``; ``lifetime_s`` after the last one its state goes.

    ``step(state, row)`` returns the new state and the rows to emit.
    """

    def __init__(self, columns: list[str], out: list[str], start, step, lifetime_s: int):
        self.columns, self.out, self.start, self.step, self.lifetime_ms = columns, out, start, step, lifetime_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at string", "row string")
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for frame in rows:
            records = frame[["t", *self.columns]].astype(object).where(frame[["t", *self.columns]].notna(), None).to_dict("records")
            for r in records:
                r = {k: v.item() if hasattr(v, "item") else v for k, v in r.items()}
                due.add(int(r["t"]) // MINUTE_US)
                self.waiting.updateValue((f"{int(r['t']) // MINUTE_US}:{r['t']}:{r['id']}",), (json.dumps(r),))
        for minute in due:
            self.handle.registerTimer((minute + 1) * MINUTE_US // 1000)
        yield pd.DataFrame(columns=[*self.out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        over = [at for (at,) in list(self.waiting.keys()) if (int(at.split(":")[0]) + 1) * MINUTE_US // 1000 <= now]
        state, out = json.loads(self.state.get()[0]) if self.state.exists() else self.start(), []
        ready = sorted((json.loads(self.waiting.getValue((at,))[0]) for at in over), key=lambda r: (r["t"], r["id"]))
        for r in ready:
            last = state.get("last")
            if last is not None and last // 1000 + self.lifetime_ms <= r["t"] // 1000:
                state = self.start()
            state, emitted = self.step(state, r)
            state["last"] = r["t"]
            out += [(*key, *e) for e in emitted]
        for at in over:
            self.waiting.removeKey((at,))
        if ready:
            self.handle.registerTimer(ready[-1]["t"] // 1000 + self.lifetime_ms)
            self.state.update((json.dumps(state),))
        elif state.get("last", 0) // 1000 + self.lifetime_ms <= now and not self.waiting.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=[*self.out])

    def close(self) -> None:
        pass


def _assign(state: dict, r: dict) -> tuple[dict, list]:
    fold = Fold()
    fold.segment = 0
    fold.open.extend(tuple(a) for a in state["open"])
    incident = fold(0, r["id"], r["t"] / 1e6, r["lat"], r["lon"], r["place"])
    return {"open": [list(a) for a in fold.open]}, [(r["id"], incident)]


def _changed(state: dict, r: dict) -> tuple[dict, list]:
    before = state["is"]
    now = r["says"] or before
    return {"is": now}, [(r["id"], before, now)] if now != before else []


def _notified(state: dict, r: dict) -> tuple[dict, list]:
    """A subscriber joins the list; a change from ACTIVE to CLEAR tells all of them and empties it. UNKNOWN is no evidence."""
    if r["subscriber"] is not None:
        return state | {"list": sorted({*state["list"], r["subscriber"]})}, []
    says = r["says"] if r["says"] in ("ACTIVE", "CLEAR") else state["is"]
    if state["is"] == "ACTIVE" and says == "CLEAR":
        return {"is": says, "list": []}, [(r["id"], s) for s in state["list"]]
    return state | {"is": says}, []


def _keyed(reports: DataFrame, late: str, columns: list[str], out: str, start, step, lifetime_s: int) -> DataFrame:
    rows = reports.withWatermark("ts", late).withColumn("t", F.unix_micros("ts")).select("region", "ts", "t", *columns)
    names = [c.split()[0] for c in out.split(", ")]
    return rows.groupBy("region").transformWithStateInPandas(Ordered(columns, names, start, step, lifetime_s), out, "append", "eventTime")


def incidents(reports: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(region, id, incident) of a stream of reports (region, id, ts, lat, lon, place), as the batch fold assigns them."""
    return _keyed(reports, late, ["id", "lat", "lon", "place"], "region long, id long, incident long", lambda: {"open": []}, _assign, max(WINDOW_S, TEXT_WINDOW_S) + 1)


def alert_changes(reports: DataFrame, late: str = "10 minutes", lifetime_s: int = 30 * 86400) -> DataFrame:
    """(region, id, before, state) where a region's state changes in a stream of reports (region, id, ts, says: a state or null).

    A state that no report has confirmed for ``lifetime_s`` is forgotten, and the region is UNKNOWN again.
    """
    return _keyed(reports, late, ["id", "says"], "region long, id long, before string, state string", lambda: {"is": "UNKNOWN"}, _changed, lifetime_s)


def alert_subscriptions(reports: DataFrame, subscriptions: DataFrame, late: str = "10 minutes", lifetime_s: int = 30 * 86400) -> DataFrame:
    """(region, id, subscriber): who is told by which report that a region's alert is over, once each.

    ``reports`` (region, id, ts, says) and ``subscriptions`` (region, id, ts, subscriber) are streams; ids of either side count in the order of equal times. Whoever has
    subscribed to a region before its state goes from ACTIVE to CLEAR is told, and has to subscribe again. A state that is UNKNOWN or null changes nothing, so it never
    clears an alert; reports that come again are the same row. Regions without rows for ``lifetime_s`` forget state and subscribers.
    """
    both = reports.select("region", "id", "ts", "says", F.lit(None).cast("string").alias("subscriber")).unionByName(subscriptions.select("region", "id", "ts", F.lit(None).cast("string").alias("says"), "subscriber"))
    return _keyed(both, late, ["id", "says", "subscriber"], "region long, id long, subscriber string", lambda: {"is": "UNKNOWN", "list": []}, _notified, lifetime_s)
