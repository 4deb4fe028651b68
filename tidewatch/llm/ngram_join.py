"""Join of documents by the Jaccard similarity of their word shingles, with Bayesian pruning.

Documents of one word sequence form a class with a number of its own, so that rows which share a doc_id are told
apart by their texts; the row of least doc_id stands for its class. MinHash values of the representatives are cut into bands; those that share a band are candidates. A
candidate pair's values are compared a few at a time, and the pair is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below ``TOLERANCE``. What
survives is gathered by connected groups and verified exactly on the shingle sets.
Large buckets and groups are compared in tiles by different tasks, to which shingles made once are sent; only links'
counts and spanning edges leave a task, never all pairs.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import drop, map_batches, slices, stage
from tidewatch.llm.components import components, join_labels, pairs_in_runs, tiles, whole_groups

WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a band; bands; values that are compared at a time.
ROWS, BANDS, STEP = 4, 16, 8
#: Posterior probability below which a pair is dropped; representatives, and shingles, of a block; a tile compares two blocks.
TOLERANCE, TILE, SHINGLES = 1e-5, 1024, 2_000_000

VALUES = ROWS * BANDS
_WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PRIME = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], n: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of runs of ``n`` words; a shorter text is one run."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(31))) * _PRIME + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def minhash(s: np.ndarray) -> np.ndarray:
    """``VALUES`` 16-bit values of a set (all ones for the empty set)."""
    least = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(s), 4096):
        part = s[k : k + 4096]
        least = np.minimum(least, ((part[:, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=0))
    return (least & np.uint64(0xFFFF)).astype("<u2")


def matches_needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values (multiples of ``STEP``) the least matches a pair goes on with.

    With a uniform prior, m matches of n give the posterior Beta(m + 1, n - m + 1).
    """
    s = (np.arange(20000) + 0.5) / 20000
    needed = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(log - log.max())
            if density[s >= threshold].sum() / density.sum() >= tolerance:
                break
        needed.append(m)
    return needed


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the incremental comparison of ``sig`` rows does not drop."""
    matches = np.zeros(len(i), dtype=np.int64)
    for step, least in enumerate(needed):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (sig[i, part] == sig[j, part]).sum(axis=1)
        on = matches >= least
        i, j, matches = i[on], j[on], matches[on]
    return i, j


def similar_sizes(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(a, b) >= threshold * np.maximum(a, b)


def _text_key() -> F.Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t, h1, h2, size, sig) of every document: key of its text, class key, number of shingles, MinHash values."""

    def work(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                out = defaultdict(list)
                for text in b["text"].to_pylist():
                    words = words_of(text or "")
                    key = " ".join(words) if words else "\0" + (text or "")
                    s = shingles(words)
                    wide = xxhash.xxh3_128_digest(key)
                    out["h1"].append(int.from_bytes(wide[:8], "big", signed=True))
                    out["h2"].append(int.from_bytes(wide[8:], "big", signed=True))
                    out["size"].append(len(s))
                    out["sig"].append(minhash(s).tobytes())
                yield out | {"doc_id": b["doc_id"], "t": b["t"]}

    return map_batches(docs.select("doc_id", "text", _text_key().alias("t")), work, "doc_id long, t long, h1 long, h2 long, size int, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """A row per representative and band; the band's values are the bucket."""

    def work(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), "<u2").reshape(b.num_rows, VALUES)
            at = np.repeat(np.arange(b.num_rows), BANDS)
            yield {"rep": b["rep"].take(at), "band": np.tile(np.arange(BANDS), b.num_rows), "bucket": np.ascontiguousarray(sig).view("<i8").reshape(-1)}

    return map_batches(classes.where("size > 0").select("rep", "sig"), work, "rep long, band int, bucket long")


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, root): representatives and one that they reach over pairs that survive.

    Narrow rows find the buckets that several share; only rows in those take their signatures along.
    The joins are hinted to shuffle: their small sides have no bound at any size.
    """
    entries = _bands(classes)
    n = entries.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = n.select("band", "bucket", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    dealt = entries.join(n.hint("merge"), ["band", "bucket"]).join(classes.select("rep", "size", "sig").hint("merge"), "rep")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("tile", F.explode(tiles(F.col("block"), F.col("blocks"))))
    dealt = dealt.withColumn("key", F.xxhash64("band", "bucket", "tile"))
    dealt = dealt.select("key", "rep", "size", "sig").repartition("key").sortWithinPartitions("key")
    needed = matches_needed(threshold)

    def work(batches):
        for g in whole_groups(batches, "key"):
            key, rep, size = (g[c].to_numpy() for c in ("key", "rep", "size"))
            sig = np.frombuffer(b"".join(g["sig"].to_pylist()), "<u2").reshape(len(key), VALUES)
            label = np.arange(len(rep))
            for i, j in pairs_in_runs(key):
                ok = similar_sizes(size[i], size[j], threshold) & (rep[i] != rep[j])
                join_labels(label, *survivors(sig, i[ok], j[ok], needed))
            found = np.flatnonzero(label != np.arange(len(label)))
            yield {"rep": rep[found], "root": rep[label[found]]}

    return map_batches(dealt, work, "rep long, root long").distinct()


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of ascending sets."""
    if len(i) <= 2 * len(sets):
        out = np.empty(len(i), dtype=np.int64)
        for k, (a, b) in enumerate(zip(i, j, strict=True)):
            a, b = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            out[k] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common, width = np.zeros((len(sets), len(sets)), dtype=np.float32), 4096
    if len(column):
        renamed = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        cuts = np.searchsorted(renamed, np.arange(0, renamed[-1] + width + 1, width))
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = np.zeros((len(sets), width), dtype=np.float32)
            m[owner[a:b], renamed[a:b] % width] = 1
            common += m @ m.T
    return common[i, j].astype(np.int64)


def _sets(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` (doc_id, t, ...) with ``shingles`` as bytes, made once from the text of the row of that doc_id and text."""
    texts = docs.select("doc_id", _text_key().alias("t"), F.col("text")).join(members.hint("shuffle_hash"), ["doc_id", "t"])
    rest = [c for c in members.columns if c not in ("doc_id", "t")]
    types = dict(members.dtypes)

    def work(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield {c: b[c] for c in rest} | {"shingles": [shingles(words_of(t or "")).tobytes() for t in b["text"].to_pylist()]}

    return map_batches(texts.select(*rest, "text"), work, ", ".join([*(f"{c} {types[c]}" for c in rest), "shingles binary"]))


def _verified(groups: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, m, root) over groups (rep, group, weight, doc_id, t, size, sig): links to documents and to classes, and a reached one."""
    n = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    n = n.select("group", F.ceil(F.greatest(F.col("n") / TILE, F.col("s") / SHINGLES)).cast("int").alias("blocks"))
    placed = groups.drop("size").join(n, "group").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    sets = stage(_sets(placed, docs), "shingles")
    sets = sets.withColumn("tile", F.explode(tiles(F.col("block"), F.col("blocks"))))
    sets = sets.withColumn("diagonal", F.floor(F.col("tile") / F.col("blocks")) == F.pmod("tile", "blocks")).withColumn("key", F.xxhash64("group", "tile"))
    dealt = sets.select("key", "rep", "weight", "block", "diagonal", "sig", "shingles").repartition("key").sortWithinPartitions("key", "rep")
    needed = matches_needed(threshold)

    def one(g):
        rep, weight, block, diagonal = (g[c].to_numpy() for c in ("rep", "weight", "block", "diagonal"))
        first = np.concatenate([[True], rep[1:] != rep[:-1]])  # rows that repeat the representative's doc_id and text
        g, rep, weight, block, diagonal = g.filter(first), rep[first], weight[first], block[first], diagonal[first]
        sig = np.frombuffer(b"".join(g["sig"].to_pylist()), "<u2").reshape(len(rep), VALUES)
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        degree, classes, label = np.zeros(len(rep), dtype=np.int64), np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        i, j = np.triu_indices(len(rep), 1)
        ok = similar_sizes(size[i], size[j], threshold) & (diagonal[i] | (block[i] != block[j]))
        i, j = survivors(sig, i[ok], j[ok], needed)
        common = intersections(sets, i, j)
        ok = common >= threshold * (size[i] + size[j] - common) - 1e-9
        i, j = i[ok], j[ok]
        for a, b in ((i, j), (j, i)):
            np.add.at(degree, a, weight[b])
            np.add.at(classes, a, 1)
        join_labels(label, i, j)
        found = np.flatnonzero(classes)
        return rep[found], degree[found], classes[found], rep[label[found]]

    def work(batches):
        for g in whole_groups(batches, "key"):
            key = g["key"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            parts = [one(g.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            if parts:
                yield dict(zip(("rep", "n", "m", "root"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    return map_batches(dealt, work, "rep long, n long, m long, root long")


def _joined(docs: DataFrame, threshold: float) -> DataFrame:
    """Per row with a doc_id: doc_id, t, rep, class_id, n_links, n_class_links, component_id, kept.

    Of a component the class with the least doc_id (and of those with one doc_id, the class of least keys) is kept, by the
    rows of that doc_id.
    """
    rows = stage(signatures(docs), "signatures")
    classes = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t", "size", "sig")).alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "least.doc_id", "least.t", "least.size", "least.sig", "weight")
    classes = stage(classes, "classes")  # from here on the numbers stand
    candidates = stage(_candidates(classes, threshold), "candidates")
    groups = components(candidates.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), F.col("component_id").alias("group"))
    groups = stage(groups.join(classes.select("rep", "doc_id", "t", "size", "sig", "weight"), "rep"), "groups")
    links = stage(_verified(groups, docs, threshold), "links")
    drop(candidates, groups)
    ids = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), F.col("component_id").alias("part"))
    ids = ids.join(classes.select("rep", "doc_id", "h1", "h2"), "rep")
    least = ids.groupBy("part").agg(F.min(F.struct("doc_id", "h1", "h2", "rep")).alias("l")).select("part", F.col("l.doc_id").alias("component_id"), F.col("l.rep").alias("first"))
    ids = ids.select("rep", "part").join(least, "part").drop("part")
    degree = links.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    all_of = classes.select("h1", "h2", "rep", "doc_id", "weight").join(degree, "rep", "left").join(ids, "rep", "left")
    all_of = all_of.select(
        "h1", "h2", "rep", F.col("doc_id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("m", F.lit(0)).alias("n_class_links"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("first") == F.col("rep"), F.lit(True)).alias("first"),
    )
    out = rows.select("doc_id", "t", "h1", "h2").join(all_of, ["h1", "h2"]).drop("h1", "h2")
    return out.withColumn("kept", F.col("first") & (F.col("doc_id") == F.col("component_id"))).drop("first")


def join_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_class_links, component_id, kept.

    ``class_id`` is the least doc_id with the same word sequence. ``n_links`` counts the other documents
    whose shingles are alike by ``threshold`` or more (its own class included), ``n_class_links`` the other
    classes. ``component_id`` is the least doc_id that links reach, and ``kept`` marks the document that
    stands for its component. Words are runs of letters, digits and underscores in lower case; a text of fewer than
    five words is one shingle; a text without words (null and empty ones too) is alike only to equal texts. Rows that
    repeat a doc_id are returned each: with one text they are copies, with different texts documents of their own. A null
    doc_id links with nothing and has null ids. An empty table gives no rows.
    """
    out = _joined(docs.where("doc_id is not null"), threshold).drop("t", "rep")
    nowhere = docs.where("doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_class_links"),
        F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"),
    )
    return out.unionByName(nowhere)


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, of which one stays of every linked group: that of the least doc_id.

    Documents that share a doc_id but not their text are judged apart. Of rows that repeat the doc_id and the words of the
    one that stays, one text stays, by its hash, and of rows with that text one, by the hash of its columns; rows with a null
    doc_id stay all. An empty table gives no rows.
    """
    known = docs.where("doc_id is not null")
    stays = _joined(known, threshold).where("kept").groupBy("rep").agg(F.min(F.struct("doc_id", "t")).alias("l")).select("l.*")
    whole = known.select("doc_id", _text_key().alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    one = whole.join(stays.hint("shuffle_hash"), ["doc_id", "t"], "left_semi")
    one = one.groupBy("doc_id", "t").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    one = one.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
    return one.unionByName(docs.where("doc_id is null"))
