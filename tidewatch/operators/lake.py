"""Archive, upsert, retention and export of incident tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of both by key; a fresh row replaces the one before, and of rows of one batch that share a key the last by ``order`` stays."""
    both = current.withColumn("_seq", F.lit(0)).unionByName(fresh.withColumn("_seq", F.lit(1)))
    return keep_last(both, [key], ["_seq", *order]).drop("_seq")


def archive(spark: SparkSession, fresh: DataFrame, path: str, key: str, ts: str, order: list[str] | None = None) -> None:
    """Upserts ``fresh`` into a Parquet lake by year, month and day; only the days it touches are rewritten, the first time too.

    Of rows that share a key in one batch the last by ``order`` (the time, if not given) stays. The days are merged into a table beside the lake, under
    a name of its own for every run, before they are replaced, so a failed write loses nothing; that table is deleted afterwards.
    """
    order = [ts] if order is None else order
    day = fresh.withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")})
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = day.limit(0)
    if files.exists(at):
        touched = day.select("year", "month", "day").distinct()
        old = spark.read.option("basePath", path).schema(day.schema).parquet(path).join(touched, ["year", "month", "day"], "left_semi").select(*day.columns)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    upsert(old, day, key, order).write.parquet(staging)
    merged = spark.read.schema(day.schema).parquet(staging).repartition("year", "month", "day")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").parquet(path)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)


def replace_all(df: DataFrame, path: str) -> None:
    """The import of a reference table: all rows of before go."""
    df.write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, path: str, label: str) -> str:
    """Writes a backup of ``df`` under its label; one that exists is never overwritten. Returns its path."""
    at = f"{path.rstrip('/')}/{label}"
    df.write.mode("errorifexists").parquet(at)
    return at


def lake_stats(df: DataFrame) -> DataFrame:
    """Rows and bytes by file of a table that was read from files."""
    return df.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))


def retained(df: DataFrame, as_of) -> DataFrame:
    """Without noise older than a day; what is older than 90 days is marked archived."""
    age = F.lit(as_of) - F.col("ts")
    noise = (F.col("significance") < 40) & ~F.coalesce(F.col("physical"), F.lit(False)) & (age > F.expr("INTERVAL 24 HOURS"))
    return df.where(~noise).withColumn("stage", F.when(age > F.expr("INTERVAL 90 DAYS"), "ARCHIVED").otherwise(F.col("stage")))


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed header; nulls become empty fields."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def feature_collection(df: DataFrame, properties: list[str]) -> DataFrame:
    """GeoJSON features, one per row."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def archive_and_prune(spark: SparkSession, table: DataFrame, path: str, key: str, ts: str, as_of) -> DataFrame:
    """Archives ``table`` and returns what it keeps; a row is pruned only when the archive is seen to hold it.

    What the archive lacks after the upsert (rows without key or time, or of a write that failed without a word) stays, whatever its age.
    """
    archive(spark, table.where(F.col(key).isNotNull() & F.col(ts).isNotNull()), path, key, ts)
    held = spark.read.parquet(path).select(key).distinct().withColumn("_held", F.lit(True))
    marked = table.join(held, key, "left")
    safe, rest = marked.where("_held"), marked.where("_held is null")
    return retained(safe, as_of).select(*table.columns).unionByName(rest.select(*table.columns))


def merge_edges(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """``edges`` (source, target, weight, first_seen, last_seen, sample) with ``fresh`` forwards (source, target, ts, text) merged in.

    Handles are trimmed, freed of their at sign and in small letters; forwards to oneself or without an end are none. The newest forward with a text gives the
    sample, 500 characters at most; without one the old sample stays.
    """
    clean = lambda c: F.lower(F.ltrim(F.trim(c), F.lit("@")))
    new = fresh.select(clean("source").alias("source"), clean("target").alias("target"), "ts", F.when(F.length("text") > 0, F.substring("text", 1, 500)).alias("text")).where("source <> target and source <> '' and target <> ''")
    sample = F.max(F.when(F.col("text").isNotNull(), F.struct("ts", "text"))).alias("s")
    new = new.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), sample)
    both = edges.join(new, ["source", "target"], "full")
    return both.select(
        "source", "target", (F.coalesce("weight", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("weight"), F.least("first_seen", "a").alias("first_seen"), F.greatest("last_seen", "b").alias("last_seen"),
        F.coalesce("s.text", "sample").alias("sample"),
    )
