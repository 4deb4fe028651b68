"""Shared folder, staged tables, id ranges and Arrow helpers of the corpus operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidewatch-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


_STAGED: list[tuple[str, str]] = []


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back.

    It cuts the lineage: later jobs neither redo the work nor depend on an
    executor's disk. ``drop`` and ``drop_all`` delete such tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _STAGED.append((spark.sparkContext.applicationId, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*staged: DataFrame) -> None:
    """Deletes tables that ``stage`` returned; nothing may read them any more."""
    for df in staged:
        _delete(df.sparkSession, df._staged)
        _STAGED[:] = [x for x in _STAGED if x[1] != df._staged]


def staged(spark: SparkSession) -> list[str]:
    """Paths of the tables that this application has staged and not dropped."""
    return [p for app, p in _STAGED if app == spark.sparkContext.applicationId]


def drop_all(spark: SparkSession, but: Iterable[str] = ()) -> None:
    """Deletes the tables this application has staged, ``but`` some; call it once the results that read them are written."""
    keep = set(but)
    gone = [p for p in staged(spark) if p not in keep]
    for path in gone:
        _delete(spark, path)
    _STAGED[:] = [x for x in _STAGED if x[1] not in gone]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most ``n`` ascending values of ``column`` that start ranges of about as many rows.

    Reads that column alone, twice. The list is as long as the number of partitions, whatever the
    number of rows. Quantiles are doubles, so the ranges they cut are approximate for long ids; each is then
    named by the least value that occurs in it, exactly, and ranges without rows are left out.
    """
    known = df.where(F.col(column).isNotNull()).select(column)
    found = known.approxQuantile(column, [i / n for i in range(1, n)], min(0.01, 1 / (8 * n))) if n > 1 else []
    cuts = sorted({min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in found})
    rows = known.groupBy(range_bucket(F.col(column), [-(1 << 63), *cuts]).alias("b")).agg(F.min(column).alias("least")).collect()  # a row per range
    return sorted(r.least for r in rows)


def range_bucket(column: Column, bounds: list[int]) -> Column:
    """Index of the last bound at or below ``column`` (0 for nulls), in two short searches."""
    if len(bounds) < 2:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    coarse, every = F.lit(bounds[::step]), F.lit(bounds)
    at_or_below = lambda x: x <= column
    first = F.greatest(F.size(F.filter(coarse, at_or_below)) - 1, F.lit(0)) * step
    inside = F.greatest(F.size(F.filter(F.slice(every, first + 1, F.lit(step)), at_or_below)) - 1, F.lit(0))
    return (first + inside).cast("int")


def join_hubs(rows: DataFrame, found: DataFrame, key: str | list[str], hub: int) -> DataFrame:
    """``rows`` joined with ``found`` (``key``, ``_n`` and more, a row per key), without ``_n``.

    Keys whose ``_n`` is above ``hub`` come by broadcast, so that no task holds all rows of one of them. ``_n`` counts rows, and ``hub``
    is a set share of all rows, which bounds the number of such keys.
    """
    hubs = F.broadcast(found.where(F.col("_n") > hub))
    rest = rows.join(hubs.select(key), key, "left_anti").join(found.where(F.col("_n") <= hub), key)
    return rows.join(hubs, key).unionByName(rest).drop("_n")


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a generator that yields columns as a dict of lists or arrays."""
    spark_schema = T.StructType.fromDDL(schema)
    arrow = to_arrow(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose ``column`` holds about ``most_bytes`` at most (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str = "doc_id", modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
