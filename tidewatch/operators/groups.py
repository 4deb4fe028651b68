"""Groups of reports that may share incidents: connected cells and place texts by clock time."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.shared import shared_dir


def connected(edges: DataFrame) -> DataFrame:
    """(node, group) of every end of ``edges`` (a, b longs): the least node that it reaches.

    Every round links the larger neighbours of a node with the least one, and then the smaller ones, so that paths shrink by a
    constant factor a round. Rounds are tables in the shared folder; the two of the round before are not read again. Nulls and loops are no edges.
    """
    spark, folder = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/groups-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def with_least(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("a").agg(F.min("b").alias("m")), "a")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    before, after, at = None, mark(now), 0
    while before != after:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).select(F.col("b").alias("a"), F.least("a", "m").alias("b"), F.col("a").alias("old")).where("a > old").select("a", "b").distinct()
        least = F.col("m")
        small = with_least(large).select(F.when(F.col("b") == least, F.col("a")).otherwise(F.col("b")).alias("a"), least.alias("b")).where("a <> b").distinct()
        at += 1
        now = kept(small, f"edges-{at}")
        before, after = after, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())


def grouped(reports: DataFrame, window_s: int, reach: float, alike: tuple[str, ...] = ("place",)) -> DataFrame:
    """``reports`` (region, id, t, lat, lon, fallback and the columns ``alike``) with ``_group``: no incident has reports of two groups.

    An incident's position moves on a segment between it and a report within ``reach``, so it stays within ``reach`` of its last
    located report, and whatever finds it is within twice that and within the window. Nodes are therefore cells of twice the reach
    by spans of the window, linked with the cells around them in the same and the next span; reports of an equal value of a column of ``alike``
    in the same or neighbouring spans are linked too. A hash stands for a node: two nodes of one hash only make a larger group. The work grows with
    occupied cells and values, not with reports.
    """
    size = 2 * reach * (1 + 1e-9)
    slot = F.floor(F.col("t") / window_s)
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.coalesce("fallback", F.lit(False))
    of_cell = lambda y, x, s: F.xxhash64("region", F.lit("cell"), s, y, x)
    of_value = lambda c, s: F.xxhash64("region", F.lit(c), s, c)
    y, x = F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)
    values = {f"_node_{c}": F.when(F.col(c).isNotNull(), of_value(c, slot)) for c in alike}
    marked = reports.withColumns({"_cell": F.when(located, of_cell(y, x, slot))} | values)

    near = F.array(*(of_cell(F.col("y") + i, F.col("x") + j, F.col("s") + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (0, 1)))
    cells = marked.where(located).select("region", y.alias("y"), x.alias("x"), slot.alias("s"), F.col("_cell").alias("a")).distinct()
    there = lambda df: df.select(F.col("a").alias("b")).distinct()
    edges = cells.select("a", F.explode(near).alias("b")).join(there(cells), "b", "left_semi").select("a", "b")
    for c in alike:
        held = marked.where(F.col(c).isNotNull()).select("region", c, slot.alias("s"), F.col(f"_node_{c}").alias("a")).distinct()
        edges = edges.unionByName(held.select("a", of_value(c, F.col("s") + 1).alias("b")).join(there(held), "b", "left_semi").select("a", "b"))
    first = F.coalesce("_cell", *values)
    for c in values:
        edges = edges.unionByName(marked.where(F.col(c).isNotNull() & (first != F.col(c))).select(first.alias("a"), F.col(c).alias("b")).distinct())
    groups = connected(edges).withColumnRenamed("node", "_node")
    alone: Column = F.xxhash64(F.lit("alone"), "region", "id")
    out = marked.withColumn("_node", first).join(groups, "_node", "left").withColumn("_group", F.coalesce("group", "_node", alone))
    return out.drop("_cell", "_node", "group", *values)
