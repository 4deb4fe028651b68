"""Best-fit packing by exact-complement hashing over length counts.

Pieces of one length are interchangeable, so the plan is made on the counts of
lengths (at most ``capacity`` numbers, whatever the corpus): singles, pairs and
triples of lengths are indexed by their sums, combinations that exactly fill the
gap beside a longest piece are consumed as often as their counts allow, and what
remains is placed by best fit. Spark then deals the plan's places to the pieces by
their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import map_batches, slices, stage
from tidewatch.llm.byte_level import encoder

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


class Complements:
    """Index of single, pair and triple length sums under availability counts."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self._pairs: np.ndarray | None = None
        self._dirty = 0

    def _pair_sums(self) -> np.ndarray:
        """Whether some pair of available lengths has each sum; a superset after uses."""
        if self._pairs is None or self._dirty > 64:
            has = (self.left > 0).astype(np.float64)
            n = len(has)
            size = 1 << (2 * n - 1).bit_length()
            spectrum = np.fft.rfft(has, size)
            self._pairs = np.rint(np.fft.irfft(spectrum * spectrum, size)[:n]) > 0
            self._dirty = 0
        return self._pairs

    def _enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap < len(self.left) and self.left[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair of sum ``gap`` with the longest member."""
        if gap < 2:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (self.left[a] > 0) & (self.left[gap - a] > 0)
        if gap % 2 == 0:
            ok &= (a != gap // 2) | (self.left[gap // 2] >= 2)
        at = np.flatnonzero(ok)
        return (int(a[at[0]]), int(gap - a[at[0]])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple of sum ``gap`` with the longest member that has one."""
        if gap < 3:
            return None
        sums = self._pair_sums()
        longest = np.flatnonzero(self.left[: gap - 1] > 0)[::-1]
        for a in longest[sums[gap - longest]]:
            self.left[a] -= 1
            rest = self.pair(gap - int(a))
            self.left[a] += 1
            if rest:
                return (int(a), *rest)
        return None

    def use(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
            self._dirty += self.left[x] == 0


@dataclass
class Pattern:
    """``times`` sequences of the same lengths; ``lengths`` maps a length to its number in each."""

    times: int
    lengths: dict[int, int] = field(default_factory=dict)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold exactly ``counts[length]`` pieces of each length (index 0 is unused)."""
    index, patterns = Complements(counts), []

    def take(lengths: tuple[int, ...]) -> None:
        each = {x: lengths.count(x) for x in lengths}
        times = min(int(index.left[x]) // k for x, k in each.items())
        index.use(lengths, times)
        patterns.append(Pattern(times, each))

    if index.left[capacity]:
        take((capacity,))
    rest: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while index.left[length]:
            index.left[length] -= 1
            fill = index.single(capacity - length) or index.pair(capacity - length) or index.triple(capacity - length)
            index.left[length] += 1
            if fill is None:
                rest[length] = int(index.left[length])
                index.use((length,), rest[length])
                break
            take((length, *fill))
    return patterns + best_fit(rest, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: sequences with the same free space are filled together."""
    free: dict[int, list[Pattern]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(r for r in free if r >= length):
            still = []
            for p in free.pop(room):
                if not n:
                    still.append(p)
                    continue
                fit = room // length
                whole = min(p.times, n // fit)
                if whole:
                    free[room - fit * length].append(_with(p, whole, length, fit))
                    n -= whole * fit
                if p.times > whole and 0 < n < fit:
                    free[room - n * length].append(_with(p, 1, length, n))
                    n, whole = 0, whole + 1
                if p.times > whole:
                    still.append(Pattern(p.times - whole, dict(p.lengths)))
            if still:
                free[room].extend(still)
            if not n:
                break
        fit = capacity // length
        if n >= fit:
            free[capacity - fit * length].append(Pattern(n // fit, {length: fit}))
        if n % fit:
            free[capacity - (n % fit) * length].append(Pattern(1, {length: n % fit}))
    return [p for ps in free.values() for p in ps]


def _with(p: Pattern, times: int, length: int, n: int) -> Pattern:
    return Pattern(times, p.lengths | {length: p.lengths.get(length, 0) + n})


@dataclass
class Places:
    """The plan as sorted ranges of ranks: columns of equal length."""

    key: np.ndarray
    first_rank: np.ndarray
    first_sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece of this rank among those of its length."""
        at = np.searchsorted(self.key, (length << 44) | rank, side="right") - 1
        inside = rank - self.first_rank[at]
        return self.first_sequence[at] + inside % self.times[at], self.offset[at] + inside // self.times[at] * length


def places(patterns: list[Pattern]) -> Places:
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, k in sorted(p.lengths.items(), reverse=True):
            rows.append(((length << 44) | ranks[length], ranks[length], sequence, p.times, offset))
            ranks[length] += p.times * k
            offset += k * length
        sequence += p.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Places(*(np.ascontiguousarray(c) for c in table.T))


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole pieces of ``capacity``, the shorter one first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, part, local_rank.

    ``part`` is the writing task and ``local_rank`` counts that task's pieces of one length. A null or empty text is one
    piece of the end id; repeated rows and null doc_ids have pieces each; an empty table has none.
    """
    from pyspark import TaskContext

    def work(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                out = defaultdict(list)
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    ids = np.frombuffer(enc.encode(text or ""), enc.dtype).astype("<u4").tobytes() + end
                    for i, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        out["doc_id"].append(doc_id)
                        out["piece"].append(i)
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        out["part"].append(part)
                        out["local_rank"].append(seen[length])
                        seen[length] += 1
                if out:
                    yield out

    return map_batches(
        docs.select("doc_id", "text"),
        work,
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long",
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to staged ``pieces``.

    A piece's rank within its length is the number of such pieces of earlier tasks plus
    its own task's count, so no length is ever gathered into one task: only
    (task, length) totals meet.
    """
    totals = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = stage(totals, "packing-totals")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in totals.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():  # capacity rows at most
        counts[length] = n
    table = places(plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))

    def work(batches):
        for b in batches:
            out = {n: b[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            length, rank = b["length"].to_numpy(zero_copy_only=False), b["rank"].to_numpy(zero_copy_only=False)
            out["sequence_id"], out["offset"] = table.find(length, rank)
            yield out

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), work, columns)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text) into sequences of ``capacity`` tokens.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    occur; a null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    return pack(stage(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
