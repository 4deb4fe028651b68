"""Connected components of a distributed edge list, and pairs within sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import drop, stage

#: A node with more than one in so many of all edge ends is a hub; a table of fewer edges has none.
HUBS, LEAST_EDGES = 5000, 10_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every end of ``edges`` (a, b): the least id that it reaches.

    Alternates large-star and small-star steps, whose rounds grow with the logarithm of the
    longest path. Every round is a table in the shared folder, and the one before is deleted. A hub's edges are
    not gathered: minima are aggregated before the shuffle, and a hub's minimum comes to its edges by a
    broadcast of the hubs, of which there are fewer than ``HUBS``. Nulls and loops are no edges.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = stage(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        star = _with_least(both, 2 * mark[0]).select("b", F.least("a", "m").alias("m"), "a")
        large = stage(star.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        small = _with_least(large, mark[0])
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = stage(small.distinct(), "edges")
        drop(now, large)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) with ``m``, the least b of each a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if total < LEAST_EDGES:
        return edges.join(least.select("a", "m"), "a")
    hub = F.col("n") > total // HUBS
    hubs = F.broadcast(least.where(hub).select("a", "m"))  # fewer than HUBS rows, as each has more than one in HUBS of the edges
    rest = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(~hub).select("a", "m"), "a")
    return edges.join(hubs, "a").select("a", "b", "m").unionByName(rest.select("a", "b", "m"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row.n, row.x


def pairs_in_runs(keys: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of equal neighbours in sorted ``keys``, some at a time."""
    n = len(keys)
    if n < 2:
        return
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    active, d, held, size = np.arange(n), 1, [], 0
    while True:
        active = active[active + d < end[active]]
        if not len(active):
            break
        held.append((active, active + d))
        size += len(active)
        d += 1
        if size >= most:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, size = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers ``label`` in place until linked positions share their least label."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, m = i[apart], j[apart], np.minimum(a, b)[apart]
        np.minimum.at(label, a[apart], m)
        np.minimum.at(label, b[apart], m)
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label[:] = shorter


def whole_groups(batches, key: str):
    """From batches sorted by ``key`` yields tables that never cut a group in two."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b[key]
        last = keys[b.num_rows - 1]
        cut = pc.index(keys, last).as_py()
        if held and held[-1][key][-1].as_py() == last.as_py():
            cut = 0
        if cut and rows + cut >= 1:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, rows = [], 0
        elif held and cut == 0 and held[-1][key][-1].as_py() != last.as_py():
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(b.slice(cut))
        rows += b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def tiles(block: F.Column, blocks: F.Column) -> F.Column:
    """The tiles (i <= j) that a row of ``block`` out of ``blocks`` takes part in."""
    other = F.sequence(F.lit(0), blocks - 1)
    return F.transform(other, lambda o: F.least(block, o) * blocks + F.greatest(block, o))
