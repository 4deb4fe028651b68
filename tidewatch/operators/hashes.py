"""64-bit hashes of images or texts: the newest earlier one that differs in a few bits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.shared import shared_dir

# Bits that may differ, days and rows that are looked back over.
BITS, DAYS, LOOKBACK = 5, 30, 500


def score(bits: Column) -> Column:
    return F.greatest(F.lit(50), 100 - bits * 10).cast("int")


def numbered(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``, places from 1 on in ``order``: a range sort, and the partitions' sizes (a row each) as offsets."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/numbered-{uuid.uuid4().hex}"
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_row": row})
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    return ranged.withColumn(name, F.get(F.lit(starts).cast("array<long>"), F.col("_p")) + F.col("_row") + 1).drop("_p", "_row")


def segments(hash_: Column, bits: int = BITS) -> Column:
    """The hash in ``bits`` + 1 parts, each marked with its place: hashes that differ in at most ``bits`` share one."""
    n, parts, at = bits + 1, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        parts.append(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(hash_, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("v")))
        at += width
    return F.array(*parts)


def newest_like(rows: DataFrame, lookback: int = LOOKBACK, days: float = DAYS, bits: int = BITS) -> DataFrame:
    """(id, other_id, bits): for each of ``rows`` (id, t seconds, hash long) the newest by (t, id) of the ``lookback`` before it, at most ``days`` older, whose
    hash differs in at most ``bits``; rows without one are left out, and null hashes or times neither look nor are found.

    Rows meet by an equal part of the hash and by blocks of ``lookback`` rows of the whole order, so that no key gathers more than two blocks, whatever the number of
    equal hashes.
    """
    placed = numbered(rows.where("hash is not null and t is not null").select("id", "t", "hash"), ["t", "id"])
    block = F.floor((F.col("rank") - 1) / lookback)
    there = placed.select(F.col("id").alias("other_id"), F.col("t").alias("_t"), F.col("hash").alias("_hash"), F.col("rank").alias("_rank"), block.alias("_block"), F.explode(segments(F.col("hash"), bits)).alias("_part"))
    here = placed.withColumn("_part", F.explode(segments(F.col("hash"), bits))).withColumn("_block", F.explode(F.array(block, block - 1)))
    pairs = here.join(there, ["_part", "_block"]).where((F.col("_rank") < F.col("rank")) & (F.col("_rank") >= F.col("rank") - lookback) & (F.col("_t") >= F.col("t") - days * 86400))
    pairs = pairs.withColumn("bits", F.bit_count(F.col("hash").bitwiseXOR(F.col("_hash")))).where(F.col("bits") <= bits)
    best = pairs.groupBy("id").agg(F.max(F.struct("_rank", "other_id", "bits")).alias("m"))
    return best.select("id", "m.other_id", "m.bits")


def with_recycled(reports: DataFrame, days: float = DAYS) -> DataFrame:
    """``reports`` (id, t, hash) with ``recycled``: whether an earlier report's image is like theirs."""
    found = newest_like(reports, days=days).select("id", F.lit(True).alias("recycled"))
    return reports.drop("recycled").join(found, "id", "left").withColumn("recycled", F.coalesce("recycled", F.lit(False)))
