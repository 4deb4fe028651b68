"""Incident clustering: an anchored, order-dependent fold, in batch and over a stream."""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import scoring
from tidewatch.plans.shared import shared_dir

WINDOW_S = 30 * 60
TEXT_WINDOW_S = 25 * 60
CELL_DEGREES = 0.08


class Fold:
    """Assigns each report, in order, to the newest incident whose anchor is near in time and place.

    The anchor is an incident's first report and never moves, so merging does not extend the window. A report that finds
    none by its position, or has none, joins the newest incident of equal place text that began within the shorter text window.
    """

    def __init__(self, window_s: float = WINDOW_S, reach: float = CELL_DEGREES, text_window_s: float = TEXT_WINDOW_S):
        self.window_s, self.reach, self.text_window_s, self.segment = window_s, reach, text_window_s, None
        self.open: deque = deque()  # anchors still within the window, newest last

    def __call__(self, segment, key, t, lat, lon, place):
        if segment != self.segment:
            self.segment = segment
            self.open.clear()
        while self.open and self.open[0][0] < t - max(self.window_s, self.text_window_s):
            self.open.popleft()
        if lat is not None and lon is not None:
            for began, incident, alat, alon, _ in reversed(self.open):
                if began >= t - self.window_s and alat is not None and math.hypot(alat - lat, alon - lon) <= self.reach:
                    return incident
        if place is not None:
            for began, incident, _, _, aplace in reversed(self.open):
                if began >= t - self.text_window_s and place == aplace:
                    return incident
        self.open.append((t, key, lat, lon if lat is not None else None, place))
        return key


def stretches(reports: DataFrame, window_s: int) -> DataFrame:
    """``reports`` (region, t, ...) with ``_segment``: a region is cut where no report came for longer than ``window_s``.

    Only the first and last time of each region and ``window_s`` of clock time are ordered, however many reports fall in it; no such span holds a gap.
    """
    slot = F.floor(F.col("t") / window_s)
    spans = reports.groupBy("region", slot.alias("_slot")).agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    order = Window.partitionBy("region").orderBy("_slot")
    new = F.coalesce(F.col("_low") - F.lag("_high").over(order) > window_s, F.lit(True)).cast("int")
    spans = spans.withColumn("_new", new).select("region", "_slot", F.sum("_new").over(order).alias("_segment"))
    return reports.withColumn("_slot", slot).join(spans, ["region", "_slot"]).drop("_slot")


def cluster(reports: DataFrame, window_s: int = WINDOW_S, text_window_s: int = TEXT_WINDOW_S) -> DataFrame:
    """(region, id, incident) of reports (region, id, t seconds, lat, lon, place).

    A region's reports are cut where none came for longer than the window: no incident spans such a gap, so
    each stretch folds on its own. A stretch without a gap is one task's work, batch by batch, as each choice rests on those before it.
    """
    cut = stretches(reports, max(window_s, text_window_s))
    cut = cut.select("region", "_segment", "t", "id", "lat", "lon", "place").repartition("region", "_segment").sortWithinPartitions("region", "_segment", "t", "id")
    kinds = dict(reports.dtypes)
    schema = T.StructType.fromDDL(f"region {kinds['region']}, id {kinds['id']}, incident {kinds['id']}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(window_s, text_window_s=text_window_s)
        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("region", "_segment", "id", "t", "lat", "lon", "place")), strict=True)
            chosen = [fold((region, segment), *rest) for region, segment, *rest in rows]
            yield pa.RecordBatch.from_arrays([b["region"], b["id"], pa.array(chosen, type=b["id"].type)], names=["region", "id", "incident"])

    return cut.mapInArrow(work, schema)


def raised(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row for reports that repeat ``keys``: the first by (t, id), with the best significance and confidence of all, the composite of
    those, the type of the last, and how many there were (n)."""
    order = F.struct("t", "id")
    rest = [c for c in reports.columns if c not in (*keys, "significance", "confidence", "resonance", "event_type")]
    first = F.min_by(F.struct(*rest), order).alias("_first")
    g = reports.groupBy(*keys).agg(first, F.max("significance").alias("significance"), F.max("confidence").alias("confidence"), F.max_by("event_type", order).alias("event_type"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "_first.*", "significance", "confidence", scoring.composite(F.col("significance"), F.col("confidence")).alias("resonance"), "event_type", "n")


def first_of_pairs(reports: DataFrame, keys: list[str]) -> DataFrame:
    """The first report (t, id) of each incident and signature within ``keys``; a null signature is its own value,
    and rows without both stand each alone.

    Only the first of equal pairs can be kept, so the rest need not be ordered. Of null
    signatures too: the first is kept or its incident was, and either rules out the later ones.
    """
    rest = [c for c in reports.columns if c not in (*keys, "incident", "signature")]
    order = F.struct(F.col("t").isNull(), "t", F.col("id").isNull(), "id")
    alone = F.when(F.col("incident").isNull() & F.col("signature").isNull(), F.col("id")).alias("_alone")
    first = reports.groupBy(*keys, "incident", "signature", alone).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*(F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in reports.columns))


#: Rows of which one task per window folds the last ones; more are settled by rounds over all tasks first.
FOLDED = 100_000


def unseen(reports: DataFrame, keys: list[str], folded: int = FOLDED) -> DataFrame:
    """Rows of ``reports`` (id, t, incident, signature), in order within ``keys``, whose incident and signature were on no row kept before; a null is on none.

    A row that is the first of its incident and of its signature among the rows left is kept whatever the others do, and rules out the rows that share
    one with it. Rounds of that, each a table in the shared folder, leave ever fewer rows (a logarithmic number of rounds where times do not
    conspire); once ``folded`` rows are left at most, one task per window folds them in order, holding the values seen. The result is the same whatever the number of rounds.
    """
    rows = first_of_pairs(reports, keys)
    spark, folder, at = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/unseen-{uuid.uuid4().hex}", 0

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}-{at}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}-{at}")

    key = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(*keys, c)))
    left = staged(rows.withColumns({"_i": key("incident"), "_s": key("signature"), "_o": F.struct(F.col("t").isNull().alias("tn"), "t", F.col("id").isNull().alias("idn"), "id")}), "left")
    kept = None
    while left.count() > folded:
        at += 1
        first = lambda c: left.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("_o").alias(f"_first{c}"))
        both = left.join(first("_i"), "_i", "left").join(first("_s"), "_s", "left")
        own = lambda c: F.col(c).isNull() | (F.col("_o") == F.col(f"_first{c}"))
        now = staged(both.where(own("_i") & own("_s")).select(*left.columns), "kept")
        rest = left
        for c in ("_i", "_s"):
            rest = rest.join(now.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
        left = staged(rest.where("_i is not null or _s is not null").select(*left.columns), "left")
        kept = now if kept is None else kept.unionByName(now)
    last = _folded(left.select(*rows.columns), keys)
    return last if kept is None else kept.select(*rows.columns).unionByName(last)


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in (*keys, "t", "id")]
    rows = rows.repartition(*keys).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, incidents, signatures = None, set(), set()
        for b in batches:
            kept = []
            columns = (*(b[c].to_pylist() for c in keys), b["incident"].to_pylist(), b["signature"].to_pylist())
            for *key, incident, signature in zip(*columns, strict=True):
                if key != window:
                    window, incidents, signatures = key, set(), set()
                new = (incident is None or incident not in incidents) and (signature is None or signature not in signatures)
                kept.append(new)
                if new:
                    if incident is not None:
                        incidents.add(incident)
                    if signature is not None:
                        signatures.add(signature)
            yield b.filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(work, rows.schema)
