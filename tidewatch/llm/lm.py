"""Language-model scores of documents by a log-bilinear model trained with noise-contrastive estimation.

Tokens are words and one end per text. The most frequent words are symbols of their own; any other
word belongs to one of ``BUCKETS`` symbols by its ending, and within a bucket words have the add-half
probabilities of their training counts (unseen words share one place). The model predicts a
symbol from the two before it: the score of w after u, v is ``(R C1)[u] . R[w] + (R C2)[v] . R[w] + b[w]``.
Every training task runs noise-contrastive estimation over its own tokens from the same parameters and
the results are averaged, ``ROUNDS`` times. Batched matrix products over all contexts give the
normalisers, so token probabilities sum to one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import fold, map_batches, slices, stage
from tidewatch.llm.byte_level import CHARACTERS, REMEMBERED

#: Symbols of words (the end among them) and of buckets; words whose counts every task holds at most.
WORDS, BUCKETS, FREQUENT = 384, 128, 200_000
SYMBOLS = WORDS + BUCKETS
#: Width of the model; noise words for a token; tokens of a batch; passes; step size.
WIDTH, NOISE, BATCH, ROUNDS, RATE = 32, 4, 16_384, 2, 0.03

END = b""
_STOPS = b".,;:!?\"'()[]|*%$&#"


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def bucket(word: bytes) -> int:
    """Bucket of a word by its last two characters, without marks after them."""
    ending = (word.rstrip(_STOPS) or word).decode("utf-8", "replace")[-2:]
    return xxhash.xxh32_intdigest(ending.encode()) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, bucket, c): how often each word, and the end, occurs in ``docs``.

    Tasks add up what they read before anything is shuffled, and send what they hold when it grows large.
    """

    def work(batches):
        from collections import Counter

        def out(total):
            words = list(total)
            return {"h": [key(w) for w in words], "bucket": [bucket(w) for w in words], "n": list(total.values())}

        total: Counter = Counter()
        for whole in batches:
            for b in slices(whole, "text"):
                for text in b["text"].to_pylist():
                    total.update(tokens(text or ""))
                total[END] += b.num_rows
                if len(total) > 2 * REMEMBERED:
                    yield out(total)
                    total = Counter()
        yield out(total)

    parts = map_batches(docs.select("text"), work, "h long, bucket int, n long")
    return parts.groupBy("h").agg(F.max("bucket").alias("bucket"), F.sum("n").alias("c"))


class Vocabulary:
    """Counts of frequent words (at most ``FREQUENT``), the word symbols, and totals."""

    def __init__(self, counts: DataFrame):
        sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = sums.n or 0, sums.v
        level = F.floor(F.log2("c") * 8).cast("int")
        levels = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        held, least = 0, None  # whole levels of counts, from the top, while they fit
        for at, n in levels:
            if held + n > FREQUENT:
                break
            held, least = held + n, at
        rows = [] if least is None else counts.where(level >= least).select("h", "bucket", "c").collect()  # FREQUENT rows at most
        h, b, c = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
        order = np.lexsort((h, -c))
        end = key(END)
        symbol = np.full(len(h), -1, dtype=np.int64)
        first = [i for i in order if h[i] != end][: WORDS - 1]
        symbol[first] = np.arange(1, len(first) + 1)
        symbol[h == end] = 0
        symbol = np.where(symbol < 0, WORDS + b, symbol)
        by_h = np.argsort(h)
        self.h, self.c, self.symbol = h[by_h], c[by_h], symbol[by_h]
        words = self.symbol < WORDS
        own = np.bincount(self.symbol[words], weights=self.c[words], minlength=WORDS)[:WORDS]
        own[0] = max(own[0], 1)
        every = {r.bucket: (r.n, r.v) for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        n_bucket, v_bucket = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for k, (n, v) in every.items():
            n_bucket[k], v_bucket[k] = n, v
        taken = b[first] if len(h) else np.empty(0, dtype=np.int64)
        n_bucket -= np.bincount(taken, weights=c[first] if len(h) else None, minlength=BUCKETS)[:BUCKETS]
        v_bucket -= np.bincount(taken, minlength=BUCKETS)[:BUCKETS]
        n_bucket[bucket(END)] -= own[0] if self.n else 0
        v_bucket[bucket(END)] -= 1 if self.n else 0
        #: log10 of the denominators within buckets (0 for word symbols), and the symbols' shares.
        self.inside = np.concatenate([np.zeros(WORDS), np.log10(np.maximum(n_bucket, 0) + 0.5 * (np.maximum(v_bucket, 0) + 1))])
        share = np.concatenate([own, np.maximum(n_bucket, 0)]) + 0.5
        self.share = share / share.sum()


class _Lookup:
    """Symbols, counts' logs and keys of words, remembered by word; the arrays have room for more words than are known."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self):
        self.place: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.done = self.held = 0
        self.symbol, self.log, self.h = np.empty(0, np.uint16), np.empty(0), np.empty(0, np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of ``words`` in the arrays."""
        place, new = self.place, self.words
        for w in set(words):
            if w not in place:
                place[w] = len(new)
                new.append(w)
                self.held += len(w)
        if self.done < len(new):
            fresh, v = new[self.done :], self.vocabulary
            h = np.fromiter(map(key, fresh), np.int64, len(fresh))
            at = np.minimum(np.searchsorted(v.h, h), max(len(v.h) - 1, 0))
            known = v.h[at] == h if len(v.h) else np.zeros(len(h), bool)
            symbol = np.array([WORDS + bucket(w) for w in fresh], dtype=np.int64)
            log = np.full(len(h), np.nan)
            if known.any():
                symbol[known], log[known] = v.symbol[at[known]], np.log10(v.c[at[known]] + 0.5)
            if h.size and not self.done and END in place and not known[place[END]]:
                symbol[place[END]] = 0
            if len(new) > len(self.h):
                room = max(2 * len(new), 1 << 14)
                self.symbol, self.log, self.h = (np.concatenate([x[: self.done], np.empty(room - self.done, x.dtype)]) for x in (self.symbol, self.log, self.h))
            self.symbol[self.done : len(new)], self.log[self.done : len(new)], self.h[self.done : len(new)] = symbol, log, h
            self.done = len(new)
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def symbols_of(docs: DataFrame, vocabulary) -> DataFrame:
    """Per document: its symbols, sums over words whose counts are at hand, and the keys of the others."""

    def work(batches):
        from pyspark import TaskContext

        lookup, row = _Lookup(vocabulary.value), TaskContext.get().partitionId() << 40
        lookup.find([END])
        for whole in batches:
            for b in slices(whole, "text"):
                out = {k: [] for k in ("row", "n_tokens", "symbols", "base_log", "inside_log", "n_known", "rare")}
                for text in b["text"].to_pylist():
                    at = lookup.find([*tokens(text or ""), END])
                    symbol, log = lookup.symbol[at], lookup.log[at]
                    rare = np.isnan(log)
                    out["row"].append(row)
                    out["n_tokens"].append(len(at))
                    out["symbols"].append(symbol.astype("<u2").tobytes())
                    out["base_log"].append(float(log[~rare].sum()))
                    out["inside_log"].append(float(log[~rare & (symbol >= WORDS)].sum()))
                    out["n_known"].append(int((~rare).sum()))
                    out["rare"].append(lookup.h[at[rare]])
                    row += 1
                    if lookup.done > REMEMBERED or lookup.held > CHARACTERS * 4:
                        lookup.clear()
                        lookup.find([END])
                yield out | {"doc_id": b["doc_id"], "held_out": b["held_out"]}

    columns = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, base_log double, inside_log double, n_known long, rare array<long>"
    return map_batches(docs.select("doc_id", "text", (fold() == 1).alias("held_out")), work, columns)


class Model:
    """Parameters R, C1, C2 and b as one vector; ``tables`` gives what scoring needs."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        n, d = SYMBOLS * WIDTH, WIDTH * WIDTH
        self.r = flat[:n].reshape(SYMBOLS, WIDTH)
        self.c = flat[n : n + 2 * d].reshape(2, WIDTH, WIDTH)
        self.b = flat[n + 2 * d :]

    @classmethod
    def start(cls, share: np.ndarray) -> Model:
        """Small random parameters whose first predictions are the symbols' shares."""
        rng = np.random.default_rng(5)
        c = np.stack([np.eye(WIDTH)] * 2) * 0.5
        return cls(np.concatenate([rng.normal(0, 0.1, SYMBOLS * WIDTH), c.ravel(), np.log(share)]))

    def pair_scores(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.r @ self.c[0]) @ self.r.T, (self.r @ self.c[1]) @ self.r.T

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by each context word (the bias in the first), and the normaliser of every context."""
        one, two = self.pair_scores()
        one = one + self.b
        norm = np.empty((SYMBOLS, SYMBOLS))
        top = two.max(axis=1)
        scaled = np.exp(two - top[:, None])
        for u in range(0, SYMBOLS, 64):  # sums over w of exp(one[u, w]) exp(two[v, w]), as matrix products
            part = one[u : u + 64]
            high = part.max(axis=1)
            norm[u : u + 64] = np.log(np.exp(part - high[:, None]) @ scaled.T + 1e-300) + high[:, None] + top[None, :]
        return one.astype(np.float32), two.astype(np.float32), norm.astype(np.float32)


def contexts(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the words before them and the words before those; texts begin after two ends."""
    w = np.concatenate(symbols).astype(np.int64)
    starts = np.cumsum([0] + [len(s) for s in symbols[:-1]])
    u = np.concatenate([[0], w[:-1]])
    u[starts] = 0
    v = np.concatenate([[0], u[:-1]])
    v[starts] = 0
    return w, u, v


class Trainer:
    """Adam on the noise-contrastive objective, in batches of tokens."""

    def __init__(self, flat: np.ndarray, share: np.ndarray, seed: int, rate: float):
        self.flat, self.rate, self.rng = flat.copy(), rate, np.random.default_rng(seed)
        self.prior = np.log(NOISE * share)
        self.m, self.s, self.t, self.seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0

    def step(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        model, n = Model(self.flat), len(w)
        one, two = model.pair_scores()
        # Noise words are the batch's own words in another order: their shares are the noise distribution.
        target = np.concatenate([w, *(self.rng.permutation(w) for _ in range(NOISE))])
        first, second = np.tile(u, NOISE + 1) * SYMBOLS + target, np.tile(v, NOISE + 1) * SYMBOLS + target
        odds = one.ravel()[first] + two.ravel()[second] + (model.b - self.prior)[target]
        g = -1 / (1 + np.exp(-odds))
        g[:n] += 1
        g /= n
        g1, g2 = (np.bincount(at, weights=g, minlength=SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS) for at in (first, second))
        r, (c1, c2) = model.r, model.c
        dr = g1.T @ (r @ c1) + g2.T @ (r @ c2) + g1 @ (r @ c1.T) + g2 @ (r @ c2.T)
        grad = np.concatenate([dr.ravel(), (r.T @ g1 @ r).ravel(), (r.T @ g2 @ r).ravel(), np.bincount(target, weights=g, minlength=SYMBOLS)])
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.s += 0.01 * (grad * grad - self.s)
        rate = self.rate / (1 + 0.01 * self.t)
        self.flat += rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-8)
        self.seen += n


def whole_batches(texts: Iterator[np.ndarray], size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``contexts`` of all tokens of ``texts`` in batches of ``size``; what is left of one goes with the next, and the end is a batch of its own."""
    held, n = [np.empty(0, np.int64)] * 3, 0
    group: list[np.ndarray] = []
    for s in texts:
        group.append(s)
        n += len(s)
        if n >= size:
            held, group = [np.concatenate(x) for x in zip(held, contexts(group), strict=True)], []
            whole = n // size * size
            for k in range(0, whole, size):
                yield tuple(x[k : k + size] for x in held)
            held, n = [x[whole:] for x in held], n - whole
    if group:
        held = [np.concatenate(x) for x in zip(held, contexts(group), strict=True)]
    if n:
        yield tuple(held)


def _round(rows: DataFrame, flat, share: np.ndarray, number: int) -> np.ndarray | None:
    """One pass over all training tokens: every task trains from ``flat``; the mean by tokens comes back.

    What a task learns rests on the documents it reads, in their order, and so do the scores: another number of files or another
    split of them gives other parameters of the same model.
    """
    shards = 8

    def work(batches):
        trainer = None
        for w, u, v in whole_batches(np.frombuffer(s, "<u2") for b in batches for s in b["symbols"].to_pylist()):
            if trainer is None:
                trainer = Trainer(flat.value, share, 1000 * number + zlib.crc32(w.tobytes()), RATE / (1 + number))
            trainer.step(w, u, v)
        if trainer is not None:
            for i, values in enumerate(np.array_split(trainer.flat, shards)):
                yield {"shard": [i], "weight": [float(trainer.seen)], "values": [values]}

    def mean(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for i, weight, values in zip(b["shard"].to_pylist(), b["weight"].to_pylist(), b["values"].to_pylist(), strict=True):
                total = sums.setdefault(i, [0.0, 0.0])
                total[0] += weight
                total[1] = total[1] + weight * np.array(values)
        for i, (weight, values) in sums.items():
            yield {"shard": [i], "weight": [weight], "values": [values / weight]}

    columns = "shard int, weight double, values array<double>"
    trained = map_batches(rows.select("symbols"), work, columns)
    got = sorted(map_batches(trained.repartition(shards, "shard"), mean, columns).collect())  # one vector of parameters in all
    return np.concatenate([r["values"] for r in got]) if got else None


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; see ``op5_lm_score``.

    Null and empty texts are one end token. Repeated rows are scored (and counted in training) each; a null doc_id
    goes by the empty string's fold. With no training text every word is unseen. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = stage(word_counts(docs.where(fold() != 1)), "word-counts")
    vocabulary = Vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)  # FREQUENT words at most
    rows = stage(symbols_of(docs, shared), "symbols")
    training = rows.where("not held_out")
    model = Model.start(vocabulary.share)
    for number in range(ROUNDS):
        flat = _round(training, spark.sparkContext.broadcast(model.flat), vocabulary.share, number)
        model = Model(flat) if flat is not None else model
    tables, inside = spark.sparkContext.broadcast(model.tables()), vocabulary.inside

    def work(batches):
        one, two, norm = tables.value
        for b in batches:
            logs = []
            for s in b["symbols"].to_pylist():
                w, u, v = contexts([np.frombuffer(s, "<u2")])
                logs.append(float((one[u, w].astype(float) + two[v, w] - norm[u, v]).sum() / np.log(10) - inside[w].sum()))
            yield {c: b[c] for c in ("row", "doc_id", "held_out", "n_tokens", "base_log", "inside_log", "n_known")} | {"model_log": logs}

    columns = "row long, doc_id long, held_out boolean, n_tokens long, base_log double, inside_log double, n_known long, model_log double"
    scored = map_batches(rows.drop("rare"), work, columns)
    rare = rows.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rare_log"), F.count("c").alias("rare_known"))
    zero = F.coalesce("rare_log", F.lit(0.0))
    per_token = float(np.log10(vocabulary.n + 0.5 * (vocabulary.v + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base_log") + zero - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("model_log") + F.col("inside_log") + zero).alias("score"),
    )
