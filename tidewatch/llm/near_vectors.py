"""Near-duplicate embeddings by cross-polytope hashing.

A unit vector is turned by fast pseudo-random rotations (sign flips and Hadamard
transforms, three times over); the axis nearest to it, with its sign, is its hash.
Some hashes make a bucket of a table, more of them (and more tables) the more vectors there are, so that
a bucket holds few unrelated vectors at any size. Besides its own (home) bucket a vector
probes those that its second nearest axes give. A pair is a candidate where one's home is
another's home or probe; candidates are verified by their cosine in double precision.
Only ids are dealt to buckets; vectors come to those buckets alone that a home shares with another entry.
A pair that meets in several tables counts in the first alone, so that links are counted
where they are verified and only counts and spanning edges leave a task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import map_batches, stage
from tidewatch.llm.components import components, join_labels, pairs_in_runs, tiles, whole_groups

THRESHOLD = 0.93
#: Rows of a block of a bucket; a tile compares two blocks.
TILE = 1024


def shape(n: int) -> tuple[int, int]:
    """Tables, and hashes of a bucket, for ``n`` vectors of a label.

    A table of 64 dimensions has 128 axes; there are hashes enough for 128 buckets a vector, and tables
    enough to find more than 0.98 of the pairs that just reach the threshold.
    """
    hashes = min(5, max(2, 1 + math.ceil(math.log(max(n, 2), 128))))
    return {2: 6, 3: 10, 4: 18, 5: 32}[hashes], hashes


def probes(hashes: int) -> int:
    """Home, and a bucket for the second nearest axis of each hash."""
    return hashes + 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), scaled to keep lengths: by factors of 8 at most."""
    n, d = x.shape
    left = d
    while left > 1:
        r = min(8, left)
        h = np.ones((1, 1), x.dtype)
        while len(h) < r:
            h = np.block([[h, h], [h, -h]])
        x = (x.reshape(-1, r) @ h).reshape(n, d // r, r).swapaxes(1, 2).reshape(n, d)
        left //= r
    return x / np.sqrt(x.dtype.type(d))


def codes(x: np.ndarray, tables: int, hashes: int, seed: int = 7) -> np.ndarray:
    """Buckets of unit rows ``x``: int64 of shape (rows, tables, 1 home and then probes)."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.hstack([x, np.zeros((n, wide - d))]).astype(np.float32)
    rng, at = np.random.default_rng(seed), np.arange(n)
    out = np.zeros((n, tables, probes(hashes)), dtype=np.int64)
    for t in range(tables):
        for k in range(hashes):
            y = x
            for sign in rng.choice(np.array([-1, 1], np.float32), size=(3, wide)):
                y = hadamard(y * sign)
            size = np.abs(y)
            first = size.argmax(axis=1)
            size[at, first] = -1
            second = size.argmax(axis=1)
            first, second = (axis * 2 + (y[at, axis] < 0) for axis in (first, second))
            for p in range(probes(hashes)):
                out[:, t, p] = out[:, t, p] * (2 * wide) + (second if p == k + 1 else first)
    return out


def _flat(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    a = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _coded(unique: DataFrame, tables: int, hashes: int) -> DataFrame:
    """``unique`` (label, rep, vec_id, weight, embedding) with the codes of its vectors."""

    def work(batches):
        for b in batches:
            by_size: dict[int, list[int]] = {}
            for i, n in enumerate(b["embedding"].value_lengths().to_pylist()):
                by_size.setdefault(n, []).append(i)
            for rows in by_size.values():
                part = b.take(rows)
                x = _flat(part["embedding"])
                c = codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes)
                yield {k: part[k] for k in ("label", "rep", "vec_id", "weight", "embedding")} | {"codes": list(c.reshape(len(x), -1))}

    return map_batches(unique, work, "label long, rep long, vec_id long, weight long, embedding array<double>, codes array<long>")


def _links(coded: DataFrame, tables: int, each: int, threshold: float) -> DataFrame:
    """(rep, n, root): links of a vector that were verified in a tile, and a vector that it reaches there."""
    entries = coded.select("rep", "label", F.posexplode("codes").alias("at", "bucket"))
    place, role = F.floor(F.col("at") / each).cast("int"), F.col("at") % each
    entries = entries.select("rep", place.alias("place"), role.alias("role"), F.xxhash64("label", place, "bucket").alias("key"))
    n = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == 0).alias("homes")).where("n > 1 and homes > 0")
    n = n.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    shared = entries.join(n.hint("merge"), "key").join(coded.select("rep", "label", "weight", "embedding", "codes").hint("merge"), "rep")
    dealt = shared.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("tile", F.explode(tiles(F.col("block"), F.col("blocks"))))
    dealt = dealt.withColumn("diagonal", F.floor(F.col("tile") / F.col("blocks")) == F.pmod("tile", "blocks")).withColumn("key", F.xxhash64("key", "tile"))
    columns = ["key", "rep", "label", "weight", "embedding", "place", "role", "block", "diagonal", "codes"]
    dealt = dealt.select(*columns).repartition("key").sortWithinPartitions("key")

    def work(batches):
        for g in whole_groups(batches, "key"):
            key, rep, label_of, weight, place, role, block = (g[c].to_numpy() for c in ("key", "rep", "label", "weight", "place", "role", "block"))
            diagonal, c = g["diagonal"].to_numpy(), _flat(g["codes"]).reshape(g.num_rows, tables, each)
            vectors = g["embedding"].to_pylist()
            sizes = np.array([len(v) for v in vectors])
            x = np.zeros((len(vectors), sizes.max()))
            for i, v in enumerate(vectors):
                x[i, : len(v)] = v
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            degree, label = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
            for i, j in pairs_in_runs(key):
                ok = (np.minimum(role[i], role[j]) == 0) & (rep[i] != rep[j]) & (diagonal[i] | (block[i] != block[j])) & (sizes[i] == sizes[j])
                ok &= (label_of[i] == label_of[j]) & (place[i] == place[j])
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[ok], j[ok]
                first = np.full(len(i), tables)
                for t in range(tables - 1, -1, -1):
                    first[_meet(c[i, t], c[j, t])] = t
                # Where both meet in two buckets of one table, the home of the lesser id counts if the other is there.
                low, high = np.where(rep[i] < rep[j], i, j), np.where(rep[i] < rep[j], j, i)
                at = place[i]
                there = (c[high, at] == c[low, at][:, :1]).any(axis=1)
                ok = (first == at) & np.where(there, role[low] == 0, role[high] == 0)
                i, j = i[ok], j[ok]
                np.add.at(degree, i, weight[j])
                np.add.at(degree, j, weight[i])
                join_labels(label, i, j)
            found = np.flatnonzero(degree)
            yield {"rep": rep[found], "n": degree[found], "root": rep[label[found]]}

    return map_batches(dealt, work, "rep long, n long, root long")


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one's home is another's home or probe, for codes of one table."""
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the contract of ``op6_near_vectors``.

    Only rows of one label that is not null are compared. Vectors that are null, empty, zero or hold a
    null or a non-finite component link with nothing. Rows with equal vectors and labels are linked and
    hashed once; rows that repeat a vec_id are returned each, as vectors of their own, and vectors of different lengths never link.
    A null vec_id links with nothing. An empty table gives no rows; other columns are ignored.
    """
    big = F.lit(float("inf"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)
    wide = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    rows = wide.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")))
    some = rows.where("embedding is not null")
    most = some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tables, hashes = shape(most)
    unique = some.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    unique = unique.select("label", F.monotonically_increasing_id().alias("rep"), "vec_id", "weight", "embedding")
    unique = stage(_coded(unique, tables, hashes), "vectors")  # from here on the numbers stand
    links = stage(_links(unique, tables, probes(hashes), threshold), "vector-links")
    ids = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), F.col("component_id").alias("part"))
    least = ids.join(unique.select("rep", "vec_id"), "rep").groupBy("part").agg(F.min("vec_id").alias("component_id"))
    ids = ids.join(least, "part").drop("part")
    degree = links.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = unique.select("label", "embedding", "rep", "vec_id", "weight").join(degree, "rep", "left").join(ids, "rep", "left")
    classes = classes.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = rows.select("vec_id", "label", "embedding").join(classes, ["label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
