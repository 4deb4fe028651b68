"""Join of SpotSigs fingerprints: parts by bag length, an index of rare spots, pruned Jaccard.

Equal fingerprints form a class. Spots have one order for all bags: by how often the group of hashes that they fall in occurs, then by hash.
Two bags alike by ``least`` share one of the first spots of each, and lie in one part of the lengths or in neighbouring ones; so classes
meet in cells (spot, part), where each comes to its own part and, with fewer spots, to the next. Cells of a part with the same members are one cell.
A class brings a bit for each group of its spots to a cell: bits that two classes do not share are spots that they do not share, so pairs with too
many of them are dropped. The rest is gathered by connected groups and compared exactly, each pair once, where its fingerprint goes once a tile. Large cells and
groups are compared in tiles by different tasks; only counts of links and spanning edges leave a task.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import drop, map_batches, slices, stage
from tidewatch.llm.components import components, join_labels, tiles, whole_groups
from tidewatch.llm.ngram_join import intersections
from tidewatch.llm.spotsigs import as_string, from_string, length_part, likeness, spots

#: Likeness of a link; classes, and spots, of a block (a tile compares two blocks); bits of a spot that name its group; rows of a batch.
LEAST, TILE, SPOTS, GROUP_BITS, ROWS = 0.8, 512, 2_000_000, 18, 100_000


def _often(classes: DataFrame) -> np.ndarray:
    """How many spots of all classes fall in each group of hashes: a number for each of the 2^``GROUP_BITS`` groups, whatever the input."""

    def work(batches):
        n = np.zeros(1 << GROUP_BITS, dtype=np.int64)
        for b in batches:
            for s in b["fingerprint"].to_pylist():
                np.add.at(n, from_string(s) >> (32 - GROUP_BITS), 1)
        at = np.flatnonzero(n)
        yield {"at": at, "n": n[at]}

    rows = map_batches(classes.select("fingerprint"), work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << GROUP_BITS, dtype=np.int64)
    out[rows["at"]] = rows["n"]
    return out


def _cells(classes: DataFrame, least: float) -> DataFrame:
    """(rep, size, spot, cell, own): where each class looks for its like, a row for each of its first spots.

    In the order of all spots, a bag of n looks among its n - ceil(least * n) + 1 first ones in its own part. Bags of the next part are longer, so the common spots
    of a link are 2 * least / (1 + least) of n or more, and it looks among as many fewer there.
    """
    often = _often(classes)

    def work(batches):
        held, n = [], 0
        for b in batches:
            for rep, s in zip(b["rep"].to_pylist(), b["fingerprint"].to_pylist(), strict=True):
                bag = from_string(s)
                if not len(bag):
                    continue
                part = length_part(len(bag), least)
                ordered = bag[np.lexsort((bag, often[bag >> (32 - GROUP_BITS)]))].astype(np.int64)
                for cell, share in ((part, least), (part + 1, 2 * least / (1 + least))):
                    k = len(bag) - math.ceil(share * len(bag) - 1e-9) + 1
                    held.append((np.full(k, rep), np.full(k, len(bag)), ordered[:k], np.full(k, cell), np.full(k, cell == part)))
                    n += k
                if n >= ROWS:
                    yield dict(zip(("rep", "size", "spot", "cell", "own"), map(np.concatenate, zip(*held, strict=True)), strict=True))
                    held, n = [], 0
        if held:
            yield dict(zip(("rep", "size", "spot", "cell", "own"), map(np.concatenate, zip(*held, strict=True)), strict=True))

    return map_batches(classes.select("rep", "fingerprint"), work, "rep long, size int, spot long, cell int, own boolean")


def _met(cells: DataFrame) -> DataFrame:
    """``cells`` with ``blocks``, where two classes or more meet, one of them in its own part; of cells with the same members the first."""
    busy = cells.groupBy("spot", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any").select("spot", "cell")
    shared = stage(cells.join(busy.hint("merge"), ["spot", "cell"]), "spot-met")
    who = F.struct("rep", "own")
    met = shared.groupBy("spot", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.bit_xor(F.xxhash64(who)).alias("m1"), F.bit_xor(F.xxhash64(who, F.lit(1))).alias("m2")
    )
    met = met.groupBy("cell", "n", "s", "m1", "m2").agg(F.min("spot").alias("spot"))
    met = met.select("spot", "cell", F.ceil(F.greatest(F.col("n") / TILE, F.col("s") / SPOTS)).cast("int").alias("blocks"))
    return shared.join(met.hint("merge"), ["spot", "cell"])


def bits_of(bag: np.ndarray, cell: int, least: float) -> np.ndarray:
    """A bit for each group of hashes that ``bag`` has a spot in; there are about as many groups as spots in the bags of a cell's part."""
    wide = max(3, math.ceil(math.log2(least**-cell)))
    out = np.zeros(1 << wide, dtype=bool)
    out[bag >> (32 - wide)] = True
    return np.packbits(out)


def unshared(bits: np.ndarray) -> np.ndarray:
    """How many bits each pair of rows of packed ``bits`` does not share."""
    common = np.zeros((len(bits), len(bits)), dtype=np.float32)
    for k in range(0, bits.shape[1], 512):
        part = np.unpackbits(bits[:, k : k + 512], axis=1).astype(np.float32)
        common += part @ part.T
    own = common.diagonal()
    return own[:, None] + own[None, :] - 2 * common


def _candidates(classes: DataFrame, least: float) -> DataFrame:
    """(rep, root): classes and one that they reach over pairs that their sizes and bits leave."""
    cells = stage(_cells(classes, least), "spot-cells")
    met = stage(_met(cells), "spot-cells-met")

    def bits(batches):
        held = defaultdict(list)
        for b in batches:
            for rep, cell, s in zip(b["rep"].to_pylist(), b["cell"].to_pylist(), b["fingerprint"].to_pylist(), strict=True):
                held["rep"].append(rep)
                held["cell"].append(cell)
                held["bits"].append(bits_of(from_string(s), cell, least).tobytes())
                if len(held["rep"]) >= TILE:
                    yield dict(held)
                    held.clear()
            if held["rep"]:
                yield dict(held)
            held.clear()

    asked = met.select("rep", "cell").distinct().join(classes.select("rep", "fingerprint").hint("merge"), "rep")
    asked = map_batches(asked, bits, "rep long, cell int, bits binary")
    dealt = met.join(asked.hint("merge"), ["rep", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("tile", F.explode(tiles(F.col("block"), F.col("blocks")))).withColumn("key", F.xxhash64("spot", "cell", "tile"))
    dealt = dealt.select("key", "spot", "cell", "rep", "own", "size", "bits").repartition("key").sortWithinPartitions("key", "spot", "cell")

    def work(batches):
        for g in whole_groups(batches, "key"):
            key, spot, cell, rep, own, size = (g[c].to_numpy() for c in ("key", "spot", "cell", "rep", "own", "size"))
            packed, label = g["bits"].to_pylist(), np.arange(len(key))
            new = (key[1:] != key[:-1]) | (spot[1:] != spot[:-1]) | (cell[1:] != cell[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    n, mine = size[a:b].astype(np.float64), own[a:b]
                    apart = unshared(np.frombuffer(b"".join(packed[a:b]), np.uint8).reshape(b - a, -1))
                    ok = (apart <= (1 - least) / (1 + least) * (n[:, None] + n[None, :]) + 1e-6) & (mine[:, None] | mine[None, :])
                    ok &= np.minimum(n[:, None], n[None, :]) >= least * np.maximum(n[:, None], n[None, :]) - 1e-9
                    i, j = np.nonzero(np.triu(ok, 1))
                    join_labels(label, a + i, a + j)
            found = np.flatnonzero(label != np.arange(len(label)))
            yield {"rep": rep[found], "root": rep[label[found]]}

    out = stage(map_batches(dealt, work, "rep long, root long").distinct(), "spot-candidates")
    drop(cells, met)
    return out


def _links(classes: DataFrame, least: float) -> DataFrame:
    """(rep, n, m, root): links to documents and to classes by tile of a group, and a class that they reach."""
    groups = components(_candidates(classes, least).select(F.col("rep").alias("a"), F.col("root").alias("b")))
    groups = groups.select(F.col("id").alias("rep"), F.col("component_id").alias("group")).join(classes.select("rep", "fingerprint", "weight"), "rep")
    groups = stage(groups, "spot-groups")
    blocks = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("fingerprint") * 3 / 16).alias("s"))  # 16 characters are 3 spots
    blocks = blocks.select("group", F.ceil(F.greatest(F.col("n") / TILE, F.col("s") / SPOTS)).cast("int").alias("blocks"))
    dealt = groups.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("tile", F.explode(tiles(F.col("block"), F.col("blocks")))).withColumn("key", F.xxhash64("group", "tile"))
    dealt = dealt.withColumn("diagonal", F.floor(F.col("tile") / F.col("blocks")) == F.pmod("tile", "blocks"))
    dealt = dealt.select("key", "group", "rep", "weight", "block", "diagonal", "fingerprint").repartition("key").sortWithinPartitions("key", "group")

    def one(g):
        rep, weight, block, diagonal = (g[c].to_numpy() for c in ("rep", "weight", "block", "diagonal"))
        bags = [from_string(x) for x in g["fingerprint"].to_pylist()]
        size = np.array([len(x) for x in bags])
        i, j = np.triu_indices(len(rep), 1)
        ok = (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9) & (diagonal[i] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        if len(i) <= 2 * len(rep):
            ok = np.array([likeness(bags[a], bags[b], least) > 0 for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
        else:
            ok = intersections(bags, i, j) >= least / (1 + least) * (size[i] + size[j]) - 1e-9
        i, j = i[ok], j[ok]
        n, m, label = np.zeros(len(rep), dtype=np.int64), np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        for a, b in ((i, j), (j, i)):
            np.add.at(n, a, weight[b])
            np.add.at(m, a, 1)
        join_labels(label, i, j)
        linked = np.flatnonzero(m)
        return rep[linked], n[linked], m[linked], rep[label[linked]]

    def work(batches):
        for g in whole_groups(batches, "key"):
            key, group = g["key"].to_numpy(), g["group"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (group[1:] != group[:-1])) + 1, [len(key)]])
            parts = [one(g.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            if parts:
                yield dict(zip(("rep", "n", "m", "root"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    out = stage(map_batches(dealt, work, "rep long, n long, m long, root long"), "spot-links")
    drop(groups)
    return out


def join_fingerprints(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document of ``prints`` (doc_id, fingerprint): doc_id, class_id, n_links, n_class_links, component_id.

    ``class_id`` is the least doc_id with the same fingerprint, ``n_links`` counts the other documents whose likeness is
    ``least`` (above 0, below 1) or more, ``n_class_links`` the other classes, ``component_id`` is the least doc_id that links
    reach. A null fingerprint is the empty one, and empty ones are alike to each other only. Rows that repeat a doc_id are
    returned each. A null doc_id links with nothing and has null ids. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < least < 1:
        raise ValueError("least lies between 0 and 1")
    rows = prints.select("doc_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    known = rows.where("doc_id is not null")
    classes = known.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("rep"), "fingerprint", "class_id", "weight"), "spot-classes")  # the numbers stand
    links = _links(classes, least)
    reached = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), F.col("component_id").alias("group"))
    reached = reached.join(classes.select("rep", "class_id"), "rep")
    least_of = reached.groupBy("group").agg(F.min("class_id").alias("component_id"))
    reached = reached.join(least_of, "group").select("rep", "component_id")
    degree = links.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    every = classes.join(degree, "rep", "left").join(reached, "rep", "left").select(
        "fingerprint", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("m", F.lit(0)).alias("n_class_links"),
        F.coalesce("component_id", "class_id").alias("component_id"),
    )
    out = known.join(every, "fingerprint").drop("fingerprint")
    none = F.lit(None).cast("long")
    nowhere = rows.where("doc_id is null").select("doc_id", none.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_class_links"), none.alias("component_id"))
    return out.unionByName(nowhere)


def join_texts(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``join_fingerprints`` of documents (doc_id, text); a null text is empty. Texts stay in their tasks: only fingerprints move."""

    def work(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield {"doc_id": b["doc_id"], "fingerprint": [as_string(spots(t or "")) for t in b["text"].to_pylist()]}

    prints = stage(map_batches(docs.select("doc_id", "text"), work, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string"), "spot-prints")
    return join_fingerprints(prints, least)
