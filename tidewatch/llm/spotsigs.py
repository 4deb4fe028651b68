"""SpotSigs document fingerprints.

A spot is an anchor (a common word) with the chain of the next ``CHAIN`` content words
after it; a fingerprint is the bag of a text's spots (the k-th of equal spots is an element of
its own). So that tables, junk and other languages have spots too, a content word whose hash is the least
among its ``REACH`` neighbours on either side is an anchor as well. The rule is the same for texts of every
length, and an edit changes only the spots around it. Likeness is the Jaccard similarity of two bags.

The query compares fixed pairs, exactly, so that nothing is partitioned or pruned in it. ``likeness`` with a bound and ``length_part`` serve
the join of all documents in ``spot_join``: bags alike by the bound are in the same or in neighbouring parts, and a comparison ends as soon
as what is left of the shorter bag cannot reach it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import map_batches, partitions, range_bounds, range_bucket

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they "
    "this to was we were which with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit "
    "nach nicht noch oder sich sie sind um und von vor war wie wir zu zum zur über "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que "
    "qui sa se ses son sont sur un une vous "
    "al como con de del el en es esta está la las lo los más no o para pero por que se si sin su sus un una y"
).split()

#: Content words in a chain; content words on either side that an anchor's hash is compared with.
CHAIN, REACH = 2, 3
#: Elements of the shorter bag that are looked up between two looks at the bound.
STEP = 64

_WORD = re.compile(r"\w+")
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)
_ANCHOR_HASHES = np.unique(np.array([xxhash.xxh64_intdigest(w) for w in ANCHORS], dtype=np.uint64))


def spots(text: str) -> np.ndarray:
    """Ascending distinct 32-bit spot hashes of ``text`` (none for a text without words)."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return np.empty(0, dtype=np.uint32)
    anchors = _ANCHOR_HASHES[np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)] == h
    content = h[~anchors]
    rank = content * _MIX
    around = np.concatenate([np.full(REACH, _LAST), rank, np.full(REACH, _LAST)])
    least = rank
    for i in range(2 * REACH + 1):
        least = np.minimum(least, around[i : i + len(rank)])
    after = np.cumsum(~anchors)
    anchors[~anchors] = rank == least
    sig, after = h[anchors], after[anchors]  # index of the next content word behind each anchor
    ended = np.concatenate([content, np.zeros(CHAIN, dtype=np.uint64)])  # chains end with the text
    for i in range(CHAIN):
        sig = (sig ^ (sig >> np.uint64(29))) * _MIX + ended[after + i]
    sig = np.sort(sig * _MIX)
    fresh = np.concatenate([[True], sig[1:] != sig[:-1]])
    nth = np.arange(len(sig)) - np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))
    sig = (sig ^ (nth.astype(np.uint64) << np.uint64(17))) * _MIX
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def as_string(s: np.ndarray) -> str:
    """The set as a string: base64 of its ascending big-endian hashes."""
    return base64.b64encode(s.astype(">u4").tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u4").astype(np.uint32)


def length_part(n: int, least: float) -> int:
    """Number of the part of bags of ``n`` spots: bags alike by ``least`` are in the same or in neighbouring parts."""
    return int(math.log(max(n, 1)) / -math.log(least) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity, or 0 where it does not reach ``least``; two empty bags are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if least and (length_part(len(b), least) - length_part(len(a), least) > 1 or len(a) < least * len(b) - 1e-9):
        return 0.0
    needed = least / (1 + least) * (len(a) + len(b)) - 1e-9  # common elements that the similarity takes
    common = 0
    for k in range(0, len(a), STEP):
        if common + len(a) - k < needed:
            return 0.0
        part = a[k : k + STEP]
        common += int((b[np.minimum(np.searchsorted(b, part), len(b) - 1)] == part).sum())
    return common / (len(a) + len(b) - common) if common >= needed else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points of the following document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see the contract of ``op1_spotsigs``.

    Documents are dealt into ranges of doc_id, once, with each range's first rows sent to the range
    before as well, so that every task sees the document that follows its last. A null text is
    empty; an empty text has the empty fingerprint. Rows with one doc_id follow each other by
    text, null doc_ids come first, and a single document follows itself. An empty table gives
    no rows; other columns are ignored.
    """
    bounds = range_bounds(docs, "doc_id", partitions(docs.sparkSession))
    n = max(1, len(bounds))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), range_bucket(F.col("doc_id"), bounds).alias("bucket"))
    least = docs.where("doc_id is null").limit(1).count() and [None] or []
    heads = [*(least or bounds[:1]), *bounds[1:]]  # the first doc_id of each range; null comes before all
    is_head = F.col("doc_id").isNull() if least else F.lit(False)
    if known := [x for x in heads if x is not None]:
        is_head = is_head | F.coalesce(F.col("doc_id").isin(known), F.lit(False))
    copies = F.when(is_head, F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("ahead")), F.struct(((F.col("bucket") + n - 1) % n).alias("to"), F.lit(1).alias("ahead")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("ahead")))
    )
    dealt = (
        own.withColumn("at", F.explode(copies))
        .select("doc_id", "text", F.col("at.to").alias("to"), F.col("at.ahead").alias("ahead"))
        .repartitionById(n, F.col("to"))
        .sortWithinPartitions("to", "ahead", "doc_id", "text")
    )

    def work(batches):
        def row(out, doc_id, text, mine, following, theirs):
            new = edited(text, following)
            fresh = spots(new)
            for k, v in (
                ("doc_id", doc_id), ("n_chars", len(text)), ("edited_sha256", hashlib.sha256(new.encode()).hexdigest()), ("fingerprint", as_string(mine)),
                ("edited_fingerprint", as_string(fresh)), ("near_edited", likeness(mine, fresh)), ("near_next", likeness(mine, theirs)), ("n_spots", len(mine)),
            ):
                out[k].append(v)

        held, done = None, False
        for b in batches:
            out = defaultdict(list)
            for doc_id, text, ahead in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["ahead"].to_pylist(), strict=True):
                if done:
                    continue
                mine = spots(text)
                if held is not None:
                    row(out, *held, text, mine)
                held, done = (doc_id, text, mine), bool(ahead)
            if out:
                yield out
        if held is not None and not done:  # the first row of the next range is missing: never lose the last one in silence
            raise RuntimeError(f"no document follows {held[0]} in its range")

    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots int"
    return map_batches(dealt, work, columns)
