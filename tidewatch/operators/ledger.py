"""The incident ledger: reports fold into incidents that carry position, trust and status along.

A report joins the newest incident within reach that began within 30 minutes, else the newest of the same place text within 25; places that name
different districts keep apart. A merge moves the position to the centre of incident and report, weighted by what each can be trusted with,
and raises the trust; so later reports depend on earlier ones. The fold runs a group of reports at a time (see ``groups``),
over sorted Arrow batches, with the open incidents in a grid.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import text
from tidewatch.operators.groups import grouped
from tidewatch.operators.spatial import within_km

# Seconds and degrees within which a report joins, ranks of incident types, and the bounds of statuses and facts.
WINDOW_S, TEXT_WINDOW_S, REACH = 30 * 60, 25 * 60, 0.08
RANKS = {"direct_strike": 5, "casualties": 5, "destruction": 4, "explosion": 3, "fire": 3, "armed_conflict": 3, "air_defense": 2, "radar_track": 1, "general_alert": 0}
VERIFIED_FROM, MERGED_VERIFIED_FROM, HEAT, LEAST_FACT = 80, 85, 25, 0.30
HALF_LIFE_S = 21 * 86400
ASSET_TYPES = ("direct_strike", "explosion", "fire", "destruction", "radar_track")

REPORT = (
    "region", "id", "t", "lat", "lon", "fallback", "place", "district", "channel", "message", "text", "event_type", "rank", "official", "media", "significance",
    "weight", "kind", "reliability", "credibility", "reputation", "radius_m", "heat", "recycled", "repeat",
)
INCIDENT = (
    "region {region}, incident {id}, first_t double, last_t double, lat double, lon double, fallback boolean, place string, source string, message {message}, text string, event_type string, "
    "official boolean, media boolean, significance int, confidence int, resonance int, status string, conflicts int, n long, sources array<string>"
)


def _half_up(x: float, digits: int = 0) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def fact(reliability: int, credibility: int, reputation: float) -> float:
    """Trust in one fact: 40 % the source's grade (1 to 6), 35 % the evidence (1 best to 6), 25 % what the source has earned."""
    x = 0.40 * ((reliability - 1) / 5.0) + 0.35 * (1.0 - (credibility - 1) / 5.0) + 0.25 * reputation
    return _half_up(max(0.0, min(1.0, x)), 3)


def ladder(total: float, officials: int, monitors: int, official: bool, media: bool) -> int:
    base = 95 if officials and total >= 2.0 else 90 if officials or official else 85 if total >= 1.5 else 70 if total >= 1.2 else 60 if monitors else 40
    return min(100, base + 8 * media)


def composite(significance: int, confidence: int) -> int:
    return min(100, max(10, math.floor(0.55 * significance + 0.45 * confidence)))


class Ledger:
    """Open incidents of one group, found by cell and by place text."""

    def __init__(self):
        self.next, self.open, self.order = 0, {}, deque()
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.places: dict[str, list[int]] = {}
        self.primary: dict[tuple, int] = {}

    @staticmethod
    def _cell(i: dict) -> tuple[int, int] | None:
        if i["lat"] is None or i["lon"] is None or i["fallback"]:
            return None
        return math.floor(i["lat"] / REACH), math.floor(i["lon"] / REACH)

    def _move(self, key: int, old, new) -> None:
        if old != new:
            if old is not None:
                held = self.cells[old]
                held.pop(bisect.bisect_left(held, key))
                if not held:
                    del self.cells[old]
            if new is not None:
                bisect.insort(self.cells.setdefault(new, []), key)

    def close(self, t: float) -> list[dict]:
        """Incidents that no report from ``t`` on can join."""
        done = []
        while self.order and self.open[self.order[0]]["first_t"] < t - WINDOW_S:
            key = self.order.popleft()
            i = self.open.pop(key)
            self._move(key, self._cell(i), None)
            if i["place"] is not None:
                held = self.places[i["place"]]
                held.pop(bisect.bisect_left(held, key))
                if not held:
                    del self.places[i["place"]]
            if self.primary.get((i["source"], i["message"])) == key:
                del self.primary[i["source"], i["message"]]
            done.append(i)
        return done

    def find(self, r: dict) -> int | None:
        best, cell = -1, self._cell(r)
        if cell is not None:
            # The report's own cell first: what it finds there bounds how far back the cells around are looked through.
            for y in (0, -1, 1):
                for x in (0, -1, 1):
                    for key in reversed(self.cells.get((cell[0] + y, cell[1] + x), ())):
                        if key < best:
                            break
                        i = self.open[key]
                        if math.hypot(i["lat"] - r["lat"], i["lon"] - r["lon"]) <= REACH:
                            best = key
                            break
        if best < 0 and r["place"] is not None and (held := self.places.get(r["place"])) and self.open[held[-1]]["first_t"] >= r["t"] - TEXT_WINDOW_S:
            best = held[-1]
        if best < 0 or (self.open[best]["district"] and r["district"] and self.open[best]["district"] != r["district"]):
            return None
        return best

    def add(self, r: dict) -> None:
        single = max(ladder(r["weight"], r["kind"] == "official", r["kind"] == "monitor", r["official"], r["media"]), int(_half_up(100 * fact(r["reliability"], r["credibility"], r["reputation"]))))
        if r["repeat"]:
            key = self.primary.get((r["channel"], r["message"]))
            if key is not None:
                raise_scores(self.open[key], r["significance"], single, r["event_type"], r["rank"])
            return
        key = self.find(r)
        if key is None:
            self._new(r, single)
        else:
            self._merge(key, self.open[key], r)

    def _new(self, r: dict, single: int) -> None:
        status = "OFFICIAL" if r["official"] else "VERIFIED" if single >= VERIFIED_FROM else "UNVERIFIED_SINGLE_SOURCE"
        status = "DISPUTED" if r["recycled"] else "VERIFIED" if r["heat"] and not r["official"] else status
        key, self.next = self.next, self.next + 1
        self.open[key] = i = {k: r[k] for k in ("region", "lat", "lon", "fallback", "place", "district", "message", "text", "event_type", "rank", "official", "media", "significance", "reputation", "radius_m")}
        i |= {"incident": r["id"], "first_t": r["t"], "last_t": r["t"], "source": r["channel"], "conflicts": 0, "n": 1, "status": status}
        i |= {"confidence": min(100, single + HEAT) if r["heat"] else single, "resonance": composite(r["significance"], single)}
        i["sources"] = {r["channel"]: (r["weight"], r["kind"])}
        self.order.append(key)
        self._move(key, None, self._cell(i))
        if i["place"] is not None:
            self.places.setdefault(i["place"], []).append(key)
        self._own(key, i)

    def _own(self, key: int, i: dict) -> None:
        if i["message"] is not None:
            self.primary[i["source"], i["message"]] = key

    def _merge(self, key: int, i: dict, r: dict) -> None:
        higher = r["rank"] > i["rank"] and not (i["official"] and not r["official"] and not r["media"])
        if r["official"] and not i["official"]:
            if self.primary.get((i["source"], i["message"])) == key:
                del self.primary[i["source"], i["message"]]
            i.update(source=r["channel"], message=r["message"], text=r["text"], reputation=r["reputation"])
            self._own(key, i)
        elif higher and not (i["official"] and not r["official"]):
            i["text"] = r["text"]
        if higher:
            i.update(event_type=r["event_type"], rank=r["rank"])
        i.update(official=i["official"] or r["official"], media=i["media"] or r["media"], significance=max(i["significance"], r["significance"]), last_t=max(i["last_t"], r["t"]), n=i["n"] + 1)
        i["sources"].setdefault(r["channel"], (r["weight"], r["kind"]))
        total, kinds = 0.0, [k for _, k in i["sources"].values()]
        for w, _ in i["sources"].values():
            total += w
        i["confidence"] = ladder(total, kinds.count("official"), kinds.count("monitor"), i["official"], i["media"])
        i["resonance"] = composite(i["significance"], i["confidence"])
        self._fuse(key, i, r)
        if i["confidence"] >= MERGED_VERIFIED_FROM:
            i["status"] = "VERIFIED"
        elif i["official"]:
            i["status"] = "OFFICIAL"

    def _fuse(self, key: int, i: dict, r: dict) -> None:
        """Moves the incident to the weighted centre of itself and the report, where both have positions within reach."""
        if None in (i["lat"], i["lon"], r["lat"], r["lon"]) or math.hypot(i["lat"] - r["lat"], i["lon"] - r["lon"]) > REACH:
            return
        facts = [(x["lat"], x["lon"], x["radius_m"], fact(r["reliability"], r["credibility"], x["reputation"])) for x in (i, r)]
        facts = [f for f in facts if f[3] >= LEAST_FACT]
        if not facts:
            return
        old, weights = self._cell(i), [c / max(m, 50.0) ** 2 for _, _, m, c in facts]
        lat, lon = (sum(f[k] * w for f, w in zip(facts, weights, strict=True)) / sum(weights) for k in (0, 1))
        off = [math.hypot((f[0] - lat) * 111320.0, (f[1] - lon) * (111320.0 * math.cos(math.radians(lat)))) for f in facts]
        conflicts = sum(f[3] > 0.5 and m > 2 * f[2] for f, m in zip(facts, off, strict=True))
        i.update(lat=_half_up(lat, 6), lon=_half_up(lon, 6), conflicts=i["conflicts"] + conflicts)
        i["confidence"] = max(i["confidence"], int(_half_up(100 * _half_up(sum(f[3] for f in facts) / len(facts), 3))))
        if conflicts:
            i["status"] = "DISPUTED"
        self._move(key, old, self._cell(i))


def raise_scores(i: dict, significance: int, confidence: int, event_type: str, rank: int) -> None:
    i.update(significance=max(i["significance"], significance), confidence=max(i["confidence"], confidence), event_type=event_type, rank=rank)
    i["resonance"] = composite(i["significance"], i["confidence"])


def with_repeats(reports: DataFrame) -> DataFrame:
    """``reports`` with ``repeat``: whether an earlier report by (t, id) has the same channel and message, and ``said``: a hash of the two where several reports have them.

    A null message repeats none.
    """
    order = F.struct("t", "id")
    first = reports.where("message is not null").groupBy("channel", "message").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    said = F.when(F.col("_first").isNotNull(), F.xxhash64("channel", "message"))
    return reports.join(first, ["channel", "message"], "left").withColumns({"repeat": F.coalesce(F.col("_first") < order, F.lit(False)), "said": said}).drop("_first")


def reputations(reports: DataFrame, reviews: DataFrame, span_s: int = 3600) -> DataFrame:
    """``reports`` (channel, t and more) with ``reputation``: what ``reviews`` (channel, t, confirmed) up to that time have left of a channel's standing.

    Confirmed and refuted reviews fade with a half-life of 21 days between reviews, to two of each; the share of confirmed ones is the
    reputation, a half without any. Sums are carried in two steps: within spans of clock time by rows, and over a channel's spans by their totals, so
    no task orders a channel's whole history. A null channel is the channel "".
    """
    rows = reports.withColumn("channel", F.coalesce("channel", F.lit("")))
    held = rows.select("channel", F.col("t").cast("double").alias("t"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"))
    seen = reviews.select(F.coalesce("channel", F.lit("")).alias("channel"), F.col("t").cast("double").alias("t"), F.col("confirmed").alias("_ok")).where("t is not null and _ok is not null")
    every = held.unionByName(seen, allowMissingColumns=True).withColumn("_s", F.floor(F.col("t") / span_s))
    review = F.col("_ok").isNotNull()
    fade = lambda s: F.pow(F.lit(2.0), s / HALF_LIFE_S)
    inside = F.col("t") - F.col("_s") * span_s
    term = lambda ok: F.when(F.col("_ok") == ok, fade(inside)).otherwise(0.0)
    spans = every.groupBy("channel", "_s").agg(F.sum(term(True)).alias("_a"), F.sum(term(False)).alias("_b"), F.max(F.when(review, F.col("t"))).alias("_last"))
    before = Window.partitionBy("channel").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    since = (F.col("_s") - F.min("_s").over(Window.partitionBy("channel"))) * span_s  # powers stay finite for half a century
    spans = spans.withColumn("_since", since)
    carried = lambda c: F.coalesce(F.sum(F.col(c) * fade(F.col("_since"))).over(before), F.lit(0.0)) / fade(F.col("_since"))
    spans = spans.select("channel", "_s", carried("_a").alias("_ka"), carried("_b").alias("_kb"), F.max("_last").over(before).alias("_kt"))
    up_to = Window.partitionBy("channel", "_s").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    every = every.withColumns({"_pa": F.sum(term(True)).over(up_to), "_pb": F.sum(term(False)).over(up_to), "_pt": F.max(F.when(review, F.col("t"))).over(up_to)})
    out = every.where("_row is not null").join(spans, ["channel", "_s"])
    last = F.coalesce("_pt", "_kt")
    faded = lambda p, k: 2.0 + (F.col(p) + F.col(k)) / fade(last - F.col("_s") * span_s)
    a, b = faded("_pa", "_ka"), faded("_pb", "_kb")
    own = [c for c in rows.columns if c != "reputation"]
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in own), F.when(last.isNull(), 0.5).otherwise(a / (a + b)).alias("reputation"))


def prepared(reports: DataFrame) -> DataFrame:
    """``reports`` without nulls where they have a default, and with their repeats marked."""
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("fallback", "official", "media", "heat", "recycled")}
    rest = {"channel": "", "kind": "other", "weight": 0.4, "reputation": 0.5, "reliability": 3, "credibility": 3, "radius_m": 2000.0, "rank": 0, "significance": 0}
    rows = reports.withColumns(flags | {c: F.coalesce(c, F.lit(v)) for c, v in rest.items()}).withColumn("t", F.col("t").cast("double"))
    return with_repeats(rows)


def with_groups(rows: DataFrame) -> DataFrame:
    """``prepared`` rows with ``_group``, the unit of the fold."""
    return grouped(rows, WINDOW_S, REACH, ("place", "said"))


def merged(reports: DataFrame) -> DataFrame:
    """Incidents of ``reports`` (the columns of ``REPORT`` but ``repeat``), one row each; reports count in the order of (t, id).

    Nulls: flags are false, a channel is "", a weight 0.4, a reputation a half, grades 3 and 3, a radius 2000 m, a rank or significance 0. A report without position
    or place stands alone. A report that repeats the message which an incident now stands for raises its scores and sets its type, also when the incident
    has ended; repeats of other merged messages, or from another region, change nothing. The reputation of an incident is that of the report it stands for. Positions
    of equal place text that are farther apart than the reach are merged but not averaged. No task holds more than the open incidents of a group.
    """
    rows = prepared(reports)
    return settled(with_groups(rows), rows)


def settled(groups: DataFrame, every: DataFrame) -> DataFrame:
    """Incidents of ``groups``, rows of whole groups (see ``with_groups``); ``every`` has the ``prepared`` rows among which late repeats are looked for."""
    cut = groups.select("_group", *REPORT).repartition("region", "_group").sortWithinPartitions("region", "_group", "t", "id")
    schema = T.StructType.fromDDL(INCIDENT.format(**dict(groups.dtypes)))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, names = to_arrow_schema(schema), schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done):
            done = [i | {"sources": sorted(i["sources"])} for i in done]
            return pa.RecordBatch.from_arrays([pa.array([i[n] for i in done], type=arrow.field(n).type) for n in names], schema=arrow)

        now, state = None, Ledger()
        for b in batches:
            done = []
            for r in b.to_pylist():
                if (r["region"], r["_group"]) != now:
                    done += state.open.values()
                    now, state = (r["region"], r["_group"]), Ledger()
                done += state.close(r["t"])
                state.add(r)
            yield out(done)
        yield out(state.open.values())

    return _raised(cut.mapInArrow(work, schema), every)


def _raised(incidents: DataFrame, rows: DataFrame) -> DataFrame:
    """Repeats that came after an incident's window raise it too: the best scores of all of them, the type of the last."""
    trust = 0.40 * ((F.col("reliability") - 1) / 5.0) + 0.35 * (1.0 - (F.col("credibility") - 1) / 5.0) + 0.25 * F.col("reputation")
    fact_ = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), trust)) * 1000 + 0.5) / 1000
    base = F.when(F.col("kind") == "official", F.when(F.col("weight") >= 2.0, 95).otherwise(90)).when(F.col("official"), 90).when(F.col("weight") >= 1.5, 85)
    base = base.when(F.col("weight") >= 1.2, 70).when(F.col("kind") == "monitor", 60).otherwise(40)
    single = F.greatest(F.least(F.lit(100), base + 8 * F.col("media").cast("int")), F.floor(100 * fact_ + 0.5).cast("int"))
    late = rows.where("repeat").select(F.col("region").alias("_region"), F.col("channel").alias("source"), "message", F.col("t").alias("_t"), F.struct("t", "id").alias("_o"), F.col("event_type").alias("_type"), F.col("significance").alias("_sig"), single.alias("_single"))
    own = incidents.select(F.col("region").alias("_region"), "incident", "first_t", "source", "message")
    hits = own.join(late, ["_region", "source", "message"]).where(F.col("_t") > F.col("first_t") + WINDOW_S).groupBy("_region", "incident").agg(
        F.max("_sig").alias("_sig"), F.max("_single").alias("_single"), F.max_by("_type", "_o").alias("_type")
    )
    out = incidents.withColumn("_region", F.col("region")).join(hits, ["_region", "incident"], "left")
    hit, sig, conf = F.col("_sig").isNotNull(), F.greatest("significance", "_sig"), F.greatest("confidence", "_single")
    again = F.greatest(F.lit(10), F.least(F.lit(100), F.floor(0.55 * sig + 0.45 * conf))).cast("int")
    new = {"significance": sig, "confidence": conf, "resonance": F.when(hit, again).otherwise(F.col("resonance")), "event_type": F.when(hit, F.col("_type")).otherwise(F.col("event_type"))}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in incidents.columns))


def with_codes(incidents: DataFrame) -> DataFrame:
    """``incidents`` with ``code``: INC, the minute it began and letters of its place; codes of one minute and place are equal."""
    return incidents.withColumn("code", text.incident_id(F.timestamp_seconds("first_t"), F.coalesce("place", F.lit("AREA"))))


def with_assets(incidents: DataFrame, assets: DataFrame, km: float = 1.2) -> DataFrame:
    """``incidents`` with ``asset``: kind, name and metres of the nearest of ``assets`` (asset_id, kind, name, lat, lon), for types that harm; null where none is near."""
    at = incidents.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("event_type").isin(*ASSET_TYPES)).select(F.col("incident").alias("id"), "region", "lat", "lon")
    # Of the assets at one position only the least id can be an incident's nearest.
    near = within_km(at, assets.groupBy("lat", "lon").agg(F.min("asset_id").alias("other_id")), km)
    best = near.groupBy("region", "id").agg(F.min(F.struct("km", "other_id")).alias("b")).select("region", F.col("id").alias("incident"), "b.km", F.col("b.other_id").alias("asset_id"))
    named = best.join(assets.select("asset_id", F.col("kind").alias("_kind"), F.col("name").alias("_name")), "asset_id")
    label = F.concat(F.col("_kind"), F.lit(": "), F.col("_name"), F.lit(" ("), F.floor(F.col("km") * 1000).cast("string"), F.lit(" m)"))
    return incidents.join(named.select("region", "incident", label.alias("asset")), ["region", "incident"], "left")
