"""Phrases whose words stand together more often than their parts would by chance, mined by pivots.

Words that occur often enough are numbered from the most frequent on. A phrase belongs to its rarest word, its
pivot. Every occurrence of a word sends a fragment of the text to that word's partition: the words up to four
places away, cut at piece ends, at rare words and at words rarer than the pivot itself, since phrases with those belong
to others. To the left the cut is also at the pivot itself, so that a phrase is counted at the first place of its
rarest word alone. Equal fragments are combined before the shuffle. Each partition then grows phrases from the pivot
outwards, a word at a time, and drops them as soon as they are too rare; the counts of what is left are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import join_hubs, map_batches, partitions, stage

# Piece ends, what words are cut at, the longest phrase, the least count, the rows of a language.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
LONGEST, LEAST, TOP = 5, 100, 2000

#: Words of a dictionary that tasks hold in memory at most; a larger one is joined.
HELD = 300_000
#: Tokens that a task gathers before it sends fragments; entries of its word counts before it sends them.
GATHERED, COUNTED = 1 << 20, 1 << 20
#: Occurrences of a pivot from which its partition is split; fragments of a row, and of a bucket before equal ones are combined.
SPLIT, ROW, COMBINE = 200_000, 4000, 500_000
#: Buckets of pivots for each shuffle partition; a task holds one bucket at a time.
BUCKETS = 16
#: A word with more than one in so many of all occurrences is a hub; there are fewer hubs than that.
HUBS = 5000
_SIDE = LONGEST - 1

_TABLE = bytes(10 if b in PIECE_ENDS else 32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in small letters, with a newline where a piece ends, and empty strings that mean nothing."""
    return text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        yield lang, text.as_py()


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word binary, n), and a row with a null word for all words of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[dict]:
            for lang, c in counts.items():
                for mark in (b"", b"\n"):
                    c.pop(mark, None)
                yield {"lang": [lang] * (len(c) + 1), "word": [None, *c], "n": [sum(c.values()), *c.values()]}
            counts.clear()

        for batch in batches:
            for lang, text in _texts(batch):
                counts.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, counts.values())) > COUNTED:
                    yield from rows()
        yield from rows()

    return map_batches(docs, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def number_words(words: DataFrame) -> DataFrame:
    """(lang, word, n, id): ids from 1 on in the order of falling counts, by a range sort and the partitions' sizes."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = stage(words.orderBy(F.desc("n"), "lang", "word").select("lang", "word", "n", F.spark_partition_id().alias("p"), row.alias("row")), "words")
    sizes = {r.p: r.c for r in ranged.groupBy("p").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row per partition
    offsets = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])]).tolist()
    return ranged.select("lang", "word", "n", (F.get(F.lit(offsets), F.col("p")) + F.col("row") + 1).cast("int").alias("id"))


def _combined(keys: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key, equal rows of a key as one with their counts added."""
    mixed = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((mixed, keys))
    keys, rows, counts = keys[order], rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return keys[starts], rows[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def fragments(ids: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, neighbours, counts) of the words ``ids``, in which 0 is a place that no phrase crosses; ``split_key`` tells a key's pivot and part.

    ``parts`` has the number of parts of each word's partition. Of a split pivot, phrases that begin left of it go by the
    word before it to parts from 0 on, those that begin with it by the word behind it to parts below -1, so each phrase is in one.
    """
    x = np.concatenate([np.zeros(_SIDE, ids.dtype), ids, np.zeros(_SIDE, ids.dtype)])
    at = np.flatnonzero(x)
    pivots = x[at]
    rows = np.zeros((len(at), 2 * _SIDE), ids.dtype)
    for step in (-1, 1):
        ok = np.ones(len(at), bool)
        for d in range(1, LONGEST):
            near = x[at + step * d]
            ok &= (near > 0) & ((near < pivots) if step < 0 else (near <= pivots))
            rows[:, _SIDE - d if step < 0 else _SIDE + d - 1] = np.where(ok, near, 0)
    before, behind = rows[:, _SIDE - 1], rows[:, _SIDE]
    many = parts[pivots]
    whole, left, right = (many == 1) & ((before > 0) | (behind > 0)), (many > 1) & (before > 0), (many > 1) & (behind > 0)
    headless = rows[right]
    headless[:, :_SIDE] = 0
    part = np.concatenate([np.full(whole.sum(), -1), _dealt(before[left]) % many[left], -2 - _dealt(behind[right]) % many[right]])
    keys = np.concatenate([pivots[whole], pivots[left], pivots[right]]).astype(np.int64) << 24 | (part + (1 << 23))
    return _combined(keys, np.concatenate([rows[whole], rows[left], headless]), np.ones(len(keys), np.int64))


def split_key(key: int) -> tuple[int, int]:
    return key >> 24, (key & ((1 << 24) - 1)) - (1 << 23)


def _dealt(values: np.ndarray) -> np.ndarray:
    """A hash below 2**31 of whole numbers."""
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of equal values."""
    bounds = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
    yield from zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def mine(pivot: int, part: int, rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts) of the pivot's phrases that occur ``least`` times or more, one array a shape.

    A shape is the number of words before and behind the pivot. Phrases of a shape extend frequent ones of the shape
    with a word less at the end (or at the front, where the pivot is last); what lacks the other word must be frequent too.
    """
    ids = {(0, 0): np.zeros(len(rows), np.int64)}
    for size in range(1, LONGEST):
        for l in range(1 if part >= 0 else 0, size + 1):  # noqa: E741
            r = size - l
            parent = ids.get((l, r - 1) if r else (l - 1, 0))
            word = rows[:, _SIDE + r - 1] if r else rows[:, _SIDE - l]
            if parent is None:
                continue
            alive = (parent >= 0) & (word > 0)
            if r and (other := ids.get((l - 1, r))) is not None:
                alive &= other >= 0
            live = np.flatnonzero(alive)
            if not len(live) or counts[live].sum() < least:
                ids[l, r] = np.full(len(rows), -1)
                continue
            _, first, inverse = np.unique(parent[live] << 32 | word[live].astype(np.int64), return_index=True, return_inverse=True)
            totals = np.zeros(len(first), np.int64)
            np.add.at(totals, inverse, counts[live])
            often = totals >= least
            now = np.full(len(rows), -1)
            now[live] = np.where(often, np.cumsum(often) - 1, -1)[inverse]
            ids[l, r] = now
            if often.any():
                found = rows[live[first[often]]]
                phrases = np.concatenate([found[:, _SIDE - l : _SIDE], np.full((len(found), 1), pivot, found.dtype), found[:, _SIDE : _SIDE + r]], axis=1)
                yield phrases, totals[often]


def _coded(docs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(ids binary) of texts by joins with the numbered words, for a dictionary that tasks can't hold: a row per text."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, lang, text in zip(batch.column("row").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                held = [t for t in tokens(text.as_py()) if t]
                for i in range(0, len(held), GATHERED):
                    some = [(i + k, t) for k, t in enumerate(held[i : i + GATHERED]) if t != b"\n"]
                    yield {"row": [row] * len(some), "lang": [lang] * len(some), "place": [p for p, _ in some], "word": [t for _, t in some]}

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    every = stage(map_batches(numbered, places, "row long, lang string, place int, word binary"), "places")
    found = join_hubs(every, words.select("lang", "word", "id", F.col("n").alias("_n")), ["lang", "word"], total // HUBS)
    return found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("found")).select(F.col("found.place").alias("places"), F.col("found.id").alias("ids"))


def _spread(places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids with a 0 where places are left out, at most one a gap."""
    gap = np.concatenate([[0], np.diff(places) > 1]).astype(np.int64)
    out = np.zeros(len(ids) + int(gap.sum()), ids.dtype)
    out[np.arange(len(ids)) + np.cumsum(gap)] = ids
    return out


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int, held: int = HELD) -> DataFrame:
    """(ids array<int>, n): phrases of two words and more that occur ``least`` times; ``words`` is numbered by ``number_words``."""
    spark = docs.sparkSession
    size = words.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    kind = np.dtype("<u2" if size < 1 << 16 else "<u4")
    # A word's parts follow from its count alone; only words above SPLIT, fewer than total / SPLIT, have more than one.
    split = {r.id: min(-(-r.n // SPLIT), 1 << 20) for r in words.where(F.col("n") > SPLIT).select("id", "n").collect()}

    def sent(arrays: Iterator[np.ndarray]) -> Iterator[dict]:
        parts = np.ones(max(size, max(split, default=0)) + 1, np.int64) if size <= held else _Parts(split)
        if size <= held:
            for word, n in split.items():
                parts[word] = n
        pending, n = [], 0

        def flush() -> Iterator[dict]:
            keys, rows, counts = fragments(np.concatenate(pending), parts)
            own = _dealt(keys) % buckets
            order = np.argsort(own, kind="stable")
            own, keys, rows, counts = own[order], keys[order], rows[order], counts[order]
            out: dict[str, list] = {"bucket": [], "n": [], "packed": []}
            for a, b in _runs(own):
                for i in range(a, b, ROW):
                    j = min(i + ROW, b)
                    # Columns one after the other, as the values of one are alike.
                    packed = keys[i:j].tobytes() + counts[i:j].astype("<u4").tobytes() + rows[i:j].T.tobytes()
                    for k, v in zip(out, (int(own[i]), j - i, pa.compress(packed, codec="zstd", asbytes=True)), strict=True):
                        out[k].append(v)
            yield out

        for ids in arrays:
            pending += [ids, np.zeros(1, kind)]
            n += len(ids) + 1
            if n >= GATHERED:
                yield from flush()
                pending, n = [], 0
        if pending:
            yield from flush()

    buckets, fields = BUCKETS * partitions(spark), "bucket int, n int, packed binary"
    if size <= held:
        codes: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "id").collect():  # HELD rows at most
            codes.setdefault(r.lang, {})[bytes(r.word)] = r.id
        shared = spark.sparkContext.broadcast(codes)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                for lang, text in _texts(batch):
                    code = shared.value.get(lang, {}).get
                    yield np.array([code(t, 0) for t in tokens(text) if t], kind)

        routed = map_batches(docs, lambda batches: sent(coded(batches)), fields)
    else:

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for batch in batches:
                for places, ids in zip(batch.column("places"), batch.column("ids"), strict=True):
                    yield _spread(places.values.to_numpy(), ids.values.to_numpy().astype(kind))

        routed = map_batches(_coded(docs, words, total), lambda batches: sent(spread(batches)), fields)

    def unpacked(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = pa.decompress(packed, decompressed_size=n * (12 + 2 * _SIDE * kind.itemsize), codec="zstd", asbytes=True)
        keys, counts = np.frombuffer(flat, np.int64, n), np.frombuffer(flat, "<u4", n, 8 * n).astype(np.int64)
        return keys, np.frombuffer(flat, kind, offset=12 * n).reshape(2 * _SIDE, n).T, counts

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held, pending = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _combined(*map(np.concatenate, zip(*held, strict=True)))

        def results() -> Iterator[dict]:
            out: dict[str, list] = {"ids": [], "n": []}
            if held:
                keys, rows, counts = merged()
                for a, b in _runs(keys):
                    if counts[a:b].sum() >= least:
                        for phrases, n in mine(*split_key(int(keys[a])), rows[a:b], counts[a:b], least):
                            out["ids"] += phrases.tolist()
                            out["n"] += n.tolist()
            yield out

        for batch in batches:
            for bucket, n, packed in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("packed"), strict=True):
                if bucket != now:
                    yield from results()
                    now, held, pending = bucket, [], 0
                held.append(unpacked(n, packed.as_buffer()))
                pending += n
                if pending > COMBINE:
                    held = [merged()]
                    pending = 0
        yield from results()

    dealt = routed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, mined, "ids array<int>, n long")


class _Parts:
    """Numbers of parts by word where a table of all words would be too long."""

    def __init__(self, split: dict[int, int]):
        self.words = np.array(sorted(split), np.int64)
        self.parts = np.array([split[w] for w in sorted(split)], np.int64)

    def __getitem__(self, words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), np.int64)
        if len(self.words):
            i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[i] == words, self.parts[i], 1)
        return out


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score); see the contract of ``op11_collocations``.

    A null text is empty and a null lang is ``und``; a language without candidates has no rows, nor has an empty table.
    Repeated rows count as often as they stand. doc_id and other columns are ignored.
    """
    clean = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = stage(count_words(clean).where(F.col("word").isNull() | (F.col("n") >= least)), "counted")
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))
    words = number_words(counted.where("word is not null"))
    phrases = stage(frequent_phrases(clean, words, least, held), "phrases")

    known = phrases.unionByName(words.select(F.array("id").alias("ids"), "n"))
    longer = phrases.select("ids", "n", F.explode(F.sequence(F.lit(2), F.size("ids"))).alias("k")).where(F.col("k") < F.size("ids"))
    inside = longer.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - F.col("k") + 1), lambda i: F.slice("ids", i, F.col("k")))).alias("ids"))
    kept = phrases.join(inside.groupBy("ids").agg(F.max("n").alias("most")), "ids", "left").where("most is null or most < n").select("ids", F.col("n").alias("a"))

    spelled = kept.select("ids", F.posexplode("ids").alias("i", "id")).join(words.select("lang", "word", "id"), "id")
    named = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", F.col("word").cast("string").alias("w")))).alias("w"))
    named = kept.join(named, "ids").join(totals, "lang").select("ids", "lang", F.array_join(F.col("w.w"), " ").alias("phrase"), "a", F.col("total").alias("n"))

    cuts = named.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    cuts = cuts.join(known.select(F.col("ids").alias("head"), F.col("n").alias("l")), "head").join(known.select(F.col("ids").alias("tail"), F.col("n").alias("r")), "tail")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(({wide('a')} * {wide('n')} * cast(1000 as decimal(4,0))) div ({wide('l')} * {wide('r')}) as long)")
    cut = F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def mine_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same phrases in DuckDB's SQL, by counting all of them."""
    return rf"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
),
pieces AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM docs),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
sized AS (SELECT lang, w, i, unnest(range(1, least({LONGEST}, len(w) - i + 1) + 1)) AS k FROM starts),
counted AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM sized GROUP BY ALL HAVING k = 1 OR count(*) >= {least}),
totals AS MATERIALIZED (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= {least}),
lengths AS (SELECT lang, f, k, w, unnest(range(2, k)) AS m FROM often),
subs AS (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM lengths),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM subs GROUP BY ALL),
kept AS MATERIALIZED (SELECT o.lang, o.phrase, o.k, o.w, o.f AS a FROM often o LEFT JOIN inside USING (lang, phrase) WHERE o.k >= 2 AND (most IS NULL OR 100 * most < 100 * o.f)),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM kept),
halves AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail FROM cut),
cuts AS (
    SELECT halves.lang, halves.phrase, a, l.f AS l, r.f AS r, n, c, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
    FROM halves JOIN often l ON l.lang = halves.lang AND l.phrase = head JOIN often r ON r.lang = halves.lang AND r.phrase = tail JOIN totals ON totals.lang = halves.lang
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM scored QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}
"""
