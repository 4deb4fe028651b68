"""Spatial joins by grid cells: radius joins and exact nearest neighbours without cross joins."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.geo import RADIUS_KM, haversine_km
from tidewatch.plans.shared import shared_dir

KM_PER_DEGREE = math.pi * RADIUS_KM / 180


def _cells(df: DataFrame, km: float, around: bool) -> DataFrame:
    """Adds grid cells at least ``km`` wide in both directions.

    Rows are bands of latitude. Every band has as many columns as fit at its end nearest to a pole, so that cells are wide enough there too; columns
    wrap at 180 degrees. ``around`` gives the cells of the neighbouring bands that lie within ``km``.
    """
    size = km / KM_PER_DEGREE * (1 + 1e-9)
    row = F.floor(F.col("lat") / size)

    def columns(r):
        far = F.greatest(F.abs(r * size), F.abs((r + 1) * size))
        # A circle of ``size`` around a point of latitude y reaches asin(sin(size) / cos(y)) to either side.
        reach = F.when(far + size >= 90, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(math.radians(min(size, 89.9)))) / F.cos(F.radians(F.least(far + size, F.lit(89.999))))))))
        return F.greatest(F.floor(360.0 / reach), F.lit(1)).cast("long")

    # Rows and columns are unfolded one after the other, so that a band's columns are counted once a row.
    rows = df.withColumn("_r", F.explode(F.array(row - 1, row, row + 1)) if around else row).withColumn("_n", columns(F.col("_r")))
    rows = rows.withColumn("_c", F.floor((F.pmod(F.col("lon") + 180.0, F.lit(360.0))) / 360.0 * F.col("_n")).cast("long"))
    column = lambda shift: F.pmod(F.col("_c") + shift, F.col("_n"))
    rows = rows.withColumn("_c", F.explode(F.array_distinct(F.array(*(column(j) for j in (-1, 0, 1))))) if around else column(0))
    return rows.withColumn("_cell", F.struct(F.col("_r").alias("r"), F.col("_c").alias("c"))).drop("_r", "_n", "_c")


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over all tasks: a small file is one task, whatever its rows meet."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pairs(left: DataFrame, right: DataFrame, km: float, **also: Column) -> DataFrame:
    """``left`` and ``right`` (lat, lon and more, the right ones as _lat, _lon) at most ``km`` apart, with ``km``; a column of ``left`` named in ``also`` is in that array of the right row.

    The right side is put in its nine neighbouring cells, so that one equi-join finds every pair.
    """
    there = _cells(right, km, True).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    for key, values in also.items():
        there = there.withColumn(key, F.explode(values))
    met = _spread(_cells(left, km, False)).join(there, ["_cell", *also])
    return met.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where(F.col("km") <= km).drop("_cell")


def within_km(left: DataFrame, right: DataFrame, km: float, digits: int | None = None, most: int = 1000) -> DataFrame:
    """Pairs of ``left`` (id, lat, lon) and ``right`` (other_id, lat, lon) at most ``km`` apart, with ``km`` (rounded to ``digits``), anywhere on the globe.

    Right rows of one position meet a left row as one, in lists of about ``most`` ids, so that distances are those of positions; the lists are
    unfolded last. There are as many rows as pairs.
    """
    spot = ["lat", "lon"]
    there = right.select("other_id", *spot)
    busy = there.groupBy(*spot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*spot, F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    there = there.join(F.broadcast(busy), spot, "left").withColumn("_part", F.pmod(F.xxhash64("other_id"), F.coalesce("_parts", F.lit(1))))
    there = there.groupBy(*spot, "_part").agg(F.collect_list(F.struct("other_id")).alias("_others")).drop("_part")
    pairs = _pairs(left, there, km).select(*left.columns, "km", "_others")
    if digits is not None:
        pairs = pairs.withColumn("km", F.round("km", digits))
    unfolded = pairs.withColumn("_other", F.explode("_others"))
    return unfolded.select(*left.columns, "_other.other_id", "km")


def _first_radius(left: DataFrame, right: DataFrame, km: float, each: float, keys: tuple[str, ...] = ()) -> float:
    """``km`` halved until the rows that share a cell make at most ``each`` pairs a row on average, or a metre is reached."""
    rows = left.count() + right.count()
    while km > 0.002:
        here, there = (_cells(df, km, False).groupBy("_cell", *keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_l"), (right, "_r")))
        pairs = here.join(there, ["_cell", *keys]).agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0.0
        if pairs <= each * rows:
            break
        km /= 2 ** min(4, max(1, math.ceil(math.log2(pairs / (each * rows)) / 2)))
    return km


class _Tables:
    """Tables of one search in the shared folder, so that no round repeats the ones before."""

    def __init__(self, spark, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def nearest(left: DataFrame, right: DataFrame, k: int, start_km: float, most_km: float = 20040.0) -> DataFrame:
    """The ``k`` nearest of ``right`` for each of ``left`` (id, other_id, km, place), exactly.

    Positions of ``left`` are searched once, and a position of ``right`` has its ``k`` least ids. A position is settled once ``k`` others lie within the
    radius; the rest are tried at twice the radius. The first radius is ``start_km`` or, where that would meet too many, a fraction of it. What a round finds
    and leaves open are tables in the shared folder; the result reads the found ones.
    """
    spot, tables = ["lat", "lon"], _Tables(left.sparkSession, "nearest")
    least = F.row_number().over(Window.partitionBy(*spot).orderBy("other_id"))
    there = right.select("other_id", *spot).where("lat is not null and lon is not null").withColumn("_k", least).where(F.col("_k") <= k).drop("_k")
    there = tables.kept(there, "right")
    open_ = tables.kept(left.select(*spot).where("lat is not null and lon is not null").distinct(), "left")
    settled, km, at = None, _first_radius(open_, there, start_km, 2.0 * k), 0
    of_spot, last = Window.partitionBy(*spot), False
    while not last:
        last = km * 2 > most_km
        ranked = _pairs(open_, there, km).select(*spot, "other_id", "km").withColumn("place", F.row_number().over(of_spot.orderBy("km", "other_id"))).where(F.col("place") <= k)
        ranked = tables.kept(ranked.withColumn("_n", F.count(F.lit(1)).over(of_spot)), f"found-{at}")
        part = ranked if last else ranked.where(F.col("_n") >= k)
        settled = part.drop("_n") if settled is None else settled.unionByName(part.drop("_n"))
        if not last:
            open_ = tables.kept(open_.join(part.where(F.col("place") == 1).select(*spot), spot, "left_anti"), f"open-{at}")
            last = open_.limit(1).count() == 0
        km, at = km * 2, at + 1
    return _spread(left.select("id", *spot)).join(settled, spot).select("id", "other_id", "km", "place")


def nearest_in_time(left: DataFrame, right: DataFrame, km: float, seconds: float, hot: int = 50_000) -> DataFrame:
    """For each of ``left`` (id, t seconds, lat, lon) the nearest of ``right`` (other_id, t, lat, lon) within ``km`` and ``seconds``, anywhere on the globe.

    Right rows of a position and a span of ``seconds`` are one, with their first and last time: a left row's own span lies wholly within its reach, and of the
    spans before and behind the last and the first time tell whether any does. So the least distance is found, by radii that double from one that suits the density
    up to ``km``. The least ``other_id`` at that distance is a running minimum along the times of each such position and span, first to last or last
    to first; one with more than ``hot`` left rows is dealt to several parts, with its right rows in each. Times count in whole microseconds.
    Distances are compared in whole metres, then the smaller ``other_id`` wins; a row without partner is left out.
    """
    spot, tables, reach = ["lat", "lon"], _Tables(left.sparkSession, "nearest-in-time"), round(seconds * 1_000_000)
    span, us = max(1, reach), F.round(F.col("t") * 1_000_000).cast("long")
    timed = lambda df, c: df.where("lat is not null and lon is not null and abs(cast(t as double)) < 9e12").select(c, *spot, us.alias("us")).withColumn("slot", F.col("us") - F.pmod("us", F.lit(span)))
    there = tables.kept(timed(right, "other_id"), "right")
    spans = tables.kept(there.groupBy(*spot, "slot").agg(F.min("us").alias("_first"), F.max("us").alias("_last")), "spans")
    around = spans.withColumnRenamed("slot", "_slot")
    slots = F.array(*(F.col("_slot") + i * span for i in (-1, 0, 1)))
    open_ = tables.kept(timed(left, "id"), "left")
    radius, at, asked = _first_radius(open_, spans, km, 0.5, ("slot",)), 0, None
    while True:
        wide = radius + 0.001
        met = (F.col("_slot") == F.col("slot")) | ((F.col("_slot") < F.col("slot")) & (F.col("_last") >= F.col("us") - reach)) | ((F.col("_slot") > F.col("slot")) & (F.col("_first") <= F.col("us") + reach))
        near = _pairs(open_, around, wide, slot=slots).where(met).withColumn("_least", F.min("km").over(Window.partitionBy("id", "us", *spot))).where(F.col("km") <= F.col("_least") + 0.002)
        near = near.withColumn("best", F.round("_least", 3)).where((F.round("km", 3) == F.col("best")) & (F.col("best") <= radius)).select("id", "us", "slot", *spot, "best", "_lat", "_lon", "_slot")
        best = tables.kept(near, f"best-{at}")
        asked = best if asked is None else asked.unionByName(best)
        if radius >= km:
            break
        open_ = tables.kept(open_.join(best.select("id", "us", *spot), ["id", "us", *spot], "left_anti"), f"open-{at}")
        if open_.limit(1).count() == 0:
            break
        radius, at = min(km, radius * 2), at + 1
    # Rows of the span before count from the left row's time minus the reach on, those of its own span and the next up to its time plus the reach.
    back = F.col("_slot") < F.col("slot")
    key = ["_lat", "_lon", "_slot", "_back"]
    asked = asked.select("id", "best", "_lat", "_lon", "_slot", back.alias("_back"), F.when(back, reach - F.col("us")).otherwise(F.col("us") + reach).alias("_at"))
    asked = tables.kept(asked, "asked")
    rows = there.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("slot").alias("_slot"), F.explode(F.array(F.lit(True), F.lit(False))).alias("_back"), "us", "other_id")
    rows = rows.withColumn("_at", F.when(F.col("_back"), -F.col("us")).otherwise(F.col("us"))).drop("us")
    busy = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    asked = asked.join(F.broadcast(busy), key, "left").withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("_parts")
    rows = rows.join(F.broadcast(busy), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    up_to = Window.partitionBy(*key, "_part").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    every = asked.withColumn("_asked", F.lit(True)).unionByName(rows, allowMissingColumns=True).withColumn("_least", F.min("other_id").over(up_to)).where("_asked")
    return every.groupBy("id").agg(F.min(F.struct(F.col("best").alias("km"), F.col("_least").isNull(), F.col("_least").alias("other_id"))).alias("m")).select("id", "m.other_id", "m.km")
