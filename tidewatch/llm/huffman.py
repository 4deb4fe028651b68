"""Token ids in files: canonical length-limited Huffman coding in independent blocks.

File format: a folder with two Parquet tables. ``codebook`` (symbol, length) has the
code lengths; codes follow from them in canonical order (by length, then symbol).
``blocks`` has a row per block of consecutive documents: ``start`` (ids of all documents
before it), ``doc_ids``, ``n_tokens`` (ids of each document), ``checkpoints`` (the bit offset
of every ``STRIDE``-th id, little-endian unsigned 32-bit) and ``payload`` (the bits, most
significant first). A block needs nothing but the codebook to be decoded, and the
checkpoints let all its strides be decoded side by side.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import map_batches, partitions, range_bounds, range_bucket, shared_dir, slices, stage
from tidewatch.llm.byte_level import encoder

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Longest code in bits; ids between checkpoints; ids after which a block is closed.
MOST_BITS, STRIDE, BLOCK = 18, 256, 1 << 19
#: Ids that are coded at a time (a multiple of ``STRIDE``).
PART = 1 << 16


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits by package-merge (0 for absent symbols)."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.int64)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << most:
        raise ValueError(f"{len(symbols)} symbols need codes of more than {most} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, levels = np.empty(0), []
    for _ in range(most):
        weights = np.concatenate([leaves, merged])
        by = np.argsort(weights, kind="stable")
        levels.append(by < len(leaves))
        weights = weights[by]
        merged = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, n = np.zeros(len(leaves) + 1, dtype=np.int64), 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:n].sum())
        take[:used] += 1  # of the lightest ``used`` leaves, one bit more
        n = 2 * (n - used)
    lengths[order] = take[:-1]
    return lengths


@dataclass
class Codebook:
    """Canonical codes and their decoding table, both from the lengths."""

    lengths: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[order]
        self.most = int(size.max()) if len(size) else 1
        slots = np.left_shift(1, self.most - size) if len(size) else np.empty(0, np.int64)
        first = np.cumsum(slots) - slots
        self.short = self.lengths.astype(np.uint8)
        self.codes = np.zeros(len(self.lengths), dtype=np.int64)
        self.codes[order] = first >> (self.most - size)
        table = np.repeat(order, slots)
        self.symbol = np.zeros(1 << self.most, dtype=np.uint32)
        self.symbol[: len(table)] = table
        self.step = np.ones(1 << self.most, dtype=np.int64)
        self.step[: len(table)] = self.lengths[table]

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints of ``ids``."""
        total = int(self.short[ids].sum(dtype=np.int64))
        words, marks, base = np.zeros((total >> 5) + 2, dtype=np.uint64), [np.empty(0, np.int64)], 0
        for k in range(0, len(ids), PART):  # in parts that a core's cache holds
            part = ids[k : k + PART]
            size = self.short[part].astype(np.int64)
            ends = np.cumsum(size) + base
            at = ends - size
            word = at >> 5
            bits = self.codes[part].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sums, word = np.add.reduceat(bits, first), word[first]  # codes do not overlap: sums are unions
            words[word] += sums >> np.uint64(32)
            words[word + 1] += sums & np.uint64(0xFFFFFFFF)
            marks.append(at[::STRIDE])
            base = int(ends[-1])
        return words.astype(">u4").tobytes()[: (total + 7) // 8], np.concatenate(marks).astype("<u4").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block; every stride is a lane, and all lanes step together."""
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        raw = np.frombuffer(payload + bytes(16), np.uint8)
        words = raw[: len(raw) // 4 * 4].view(">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out = np.empty((STRIDE, len(at)), dtype=np.uint32)
        last, mask = len(pairs) - 1, (1 << self.most) - 1
        for i in range(STRIDE):
            word = np.minimum(at >> 5, last)
            peek = (pairs[word] >> (64 - self.most - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
            out[i] = self.symbol[peek]
            at += self.step[peek]
        return out.T.reshape(-1)[:n]


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sum of two arrays of counts; the shorter one ends in zeros."""
    if len(total) < len(more):
        total, more = more.copy(), total
    total[: len(more)] += more
    return total


@lru_cache(maxsize=1)
def _decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def _unpacked(packed, dtype) -> np.ndarray:
    return np.frombuffer(_decompressor().decompress(packed), dtype)


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(doc_id, bucket, n, zids) of each document; zids are the compressed ids.

    A task's last row, with n = -1, has the compressed counts of the ids that it met; those rows are spread over the buckets.
    """
    n_buckets = max(1, len(bounds))
    df = docs.select("doc_id", "text", range_bucket(F.col("doc_id"), bounds).alias("bucket"))

    def work(batches):
        import zstandard
        from pyspark import TaskContext

        total = np.zeros(0, dtype=np.int64)
        pack, enc = zstandard.ZstdCompressor(level=1), encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for whole in batches:
            for b in slices(whole, "text"):
                ids = [enc.encode(t or "") + end for t in b["text"].to_pylist()]
                n = [len(x) // enc.dtype.itemsize for x in ids]
                every = np.frombuffer(b"".join(ids), enc.dtype)
                for k in range(0, len(every), BLOCK):
                    total = _added(total, np.bincount(every[k : k + BLOCK]))
                yield {"doc_id": b["doc_id"], "bucket": b["bucket"], "n": n, "zids": [pack.compress(x) for x in ids]}
        if len(total):
            yield {"doc_id": [None], "bucket": [TaskContext.get().partitionId() % n_buckets], "n": [-1], "zids": [pack.compress(total.tobytes())]}

    return map_batches(df, work, "doc_id long, bucket int, n long, zids binary")


def _with_position(df: DataFrame) -> DataFrame:
    """Adds ``pos``, the ids before the document within its bucket, to rows sorted by document."""

    def work(batches):
        bucket, pos = None, 0
        for b in batches:
            out = []
            for k, n in zip(b["bucket"].to_pylist(), b["n"].to_pylist(), strict=True):
                if k != bucket:
                    bucket, pos = k, 0
                out.append(pos)
                pos += max(n, 0)
            yield {c: b[c] for c in ("doc_id", "bucket", "n", "zids")} | {"pos": out}

    return map_batches(df, work, "doc_id long, bucket int, n long, zids binary, pos long")


def _ids(zids, n: int) -> np.ndarray:
    raw = _unpacked(zids, np.uint8)
    return raw.view("<u2" if len(raw) == 2 * n else "<u4")


def symbol_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents, from the tasks' own counts."""

    def work(batches):
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for z in b["zids"]:
                total = _added(total, _unpacked(z.as_buffer(), np.int64))
        ids = np.flatnonzero(total)
        yield {"symbol": ids, "n": total[ids]}

    rows = map_batches(encoded.where("n < 0").select("zids"), work, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.symbol for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        out[r.symbol] = r.n
    return out


def _blocks(encoded: DataFrame, book: Codebook, before: dict[int, int]) -> DataFrame:
    def work(batches):
        ids, docs, sizes, first, at = [], [], [], None, 0

        def block():
            payload, checkpoints = book.encode(np.concatenate(ids))
            return {"start": [first], "doc_ids": [docs], "n_tokens": [sizes], "checkpoints": [checkpoints], "payload": [payload]}

        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("doc_id", "bucket", "n", "pos")), map(pa.BinaryScalar.as_buffer, b["zids"]), strict=True)
            for doc_id, bucket, n, pos, z in rows:
                start = before[bucket] + pos
                if docs and (start != first + at or at >= BLOCK):
                    yield block()
                    ids, docs, sizes, at = [], [], [], 0
                if not docs:
                    first = start
                ids.append(_ids(z, n))
                docs.append(doc_id)
                sizes.append(n)
                at += n
        if docs:
            yield block()

    return map_batches(encoded, work, "start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, payload binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes the ids of every document of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order.

    Null and empty texts are the end id alone; null doc_ids come first; rows that share a
    doc_id follow each other by their compressed ids. An empty table gives empty tables.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", partitions(spark))
    dealt = _encoded(docs, tokenizer, end_id, bounds).repartitionById(max(1, len(bounds)), F.col("bucket"))
    every = stage(_with_position(dealt.sortWithinPartitions("bucket", "doc_id", "n", "zids")), "ids", codec="uncompressed")
    encoded, before, total = every.where("n >= 0"), {}, 0
    for r in encoded.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect():  # a row per partition
        before[r.bucket], total = total, total + r.n
    lengths = code_lengths(symbol_counts(every))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "symbol int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    _blocks(encoded, Codebook(lengths), before).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    rows = spark.read.parquet(f"{path}/codebook").collect()  # as many as the vocabulary has ids at most
    lengths = np.zeros(max((r.symbol for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        lengths[r.symbol] = r.length
    return Codebook(lengths)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; with ``digest`` (doc_id, start, n_tokens, ids_crc32).

    A row per document written: repeated rows and null doc_ids come back each, a null or empty text as the end id
    alone. Files of an empty table give no rows.
    """
    book = read_codebook(spark, path)

    def work(batches):
        for b in batches:
            rows = zip(*(b[c].to_pylist() for c in ("start", "doc_ids", "n_tokens", "checkpoints", "payload")), strict=True)
            for start, docs, sizes, checkpoints, payload in rows:
                out, ids, at = defaultdict(list), book.decode(payload, checkpoints, sum(sizes)), 0
                for doc_id, n in zip(docs, sizes, strict=True):
                    own = ids[at : at + n].astype("<u4")
                    out["doc_id"].append(doc_id)
                    out["start"].append(start + at)
                    out["n_tokens"].append(n)
                    if digest:
                        out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                    else:
                        out["ids"].append(own)
                    at += n
                yield out

    tail = "n_tokens long, ids_crc32 long" if digest else "n_tokens long, ids array<long>"
    return map_batches(spark.read.parquet(f"{path}/blocks"), work, f"doc_id long, start long, {tail}")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes the ids to files in the shared folder and returns each document's digest from them."""
    path = f"{shared_dir(docs.sparkSession)}/tidewatch/token-files-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path, digest=True)
