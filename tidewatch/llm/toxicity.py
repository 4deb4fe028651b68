"""Toxicity of documents by a lexicon with misspellings and a context window.

The lexicon (words, and stems that stand for all their continuations) and the weights are
learned from a bounded sample of labelled rows. Its terms form a trie; the Levenshtein
automata of all terms are intersected with it, determinised as words come by, so that a word is
recognised in one pass over its letters. Around a hit, misspelled or not, a window of text
tells quotation from abuse. A logistic score combines abusive, misspelled and quoted hits.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import fold, map_batches, slices
from tidewatch.llm.byte_level import REMEMBERED, _Memo

#: Labelled documents of either class that a model is fitted on at most. They bound the lexicon too, as a term needs some of them.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
#: Letters of a term from which one misspelling counts; lengths of stems; continuations that make a stem.
FUZZY_FROM, STEMS, CONTINUATIONS = 4, (4, 5, 6, 7), 4
#: Code points on either side of a hit that are searched for signs of quotation.
WINDOW = 80

#: What a misspelled hit counts of an exact one, and the share of chance terms that a lexicon may hold.
MISSPELLED, BY_CHANCE = 0.9, 0.05

#: Weights before any label is seen: none, a hit, the count of hits, quoted hits.
PRIOR = [-4.0, 4.0, 2.0, 0.5]

# Quotation marks, and words that report another's.
OPENING, CLOSING = "\"“„«‘‚‹", "\"”“»’‘›"
REPORTING = frozenset(
    "said says say called calls quote quoted quotes wrote writes term word phrase sagte sagt nannte zitat wort dit disait appelle citation mot dijo dice llamó cita palabra".split()
)

_QUOTED = re.compile(f"[{OPENING}][^{CLOSING}\\n]{{1,{WINDOW}}}[{CLOSING}]")

#: Letters with the digits among them, and the letters alone.
_WORD, _LETTERS = re.compile(r"[^\W\d_](?:[^\W_]*[^\W\d_])?"), re.compile(r"[^\W\d_]+")


class LexiconAutomaton:
    """``match(word)``: 0 for none, 1 for a term or a stem's continuation, 2 for a term misspelled by one edit (a letter more, less or
    wrong, or two neighbours swapped)."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[bool, bool, int]] = [(False, False, 0)]  # (word ends, stem ends, allowed edits)
        for term in terms:
            stem, node = term.endswith("*"), 0
            for ch in term.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append((False, False, 0))
                node = self.children[node][ch]
            word, was, edits = self.ends[node]
            self.ends[node] = (word or not stem, was or stem, max(edits, 0 if stem else int(len(term) >= FUZZY_FROM)))
        self.letters = {ch for c in self.children for ch in c}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.value: list[int] = []
        self.sure: list[bool] = []
        self.start = self._state(self._skip({(0, 0)}))

    def _skip(self, s: set[tuple[int, int | str]]) -> frozenset:
        """With one edit left, a letter of the term may be missing from the word."""
        return frozenset(s | {(c, 1) for n, e in s if e == 0 for c in self.children[n].values()})

    def _state(self, s: frozenset) -> int:
        s = frozenset((n, e) for n, e in s if e != 1 or (n, 0) not in s)
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.next.append({})
            self.sure.append(any(e == 0 and self.ends[n][1] for n, e in s))
            exact = any(e == 0 and self.ends[n][0] for n, e in s)
            near = any(e == 1 and self.ends[n][0] and self.ends[n][2] for n, e in s)
            self.value.append(1 if exact else 2 if near else 0)
        return self.states[s]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for n, e in self.sets[state]:
            if isinstance(e, str):  # the second of two swapped letters is due
                if e == ch:
                    out.add((n, 1))
                continue
            child = self.children[n].get(ch)
            if child is not None:
                out.add((child, e))
            if e == 0:
                out.add((n, 1))  # a letter too many
                out.update((c, 1) for c in self.children[n].values())  # a wrong letter
                out.update((self.children[c][ch], first) for first, c in self.children[n].items() if first != ch and ch in self.children[c])
        return self._state(self._skip(out))

    def match(self, word: str) -> int:
        state, known = self.start, self.letters
        for ch in word:
            if ch not in known:
                ch = ""
            to = self.next[state].get(ch)
            if to is None:
                to = self.next[state][ch] = self._step(state, ch)
            state = to
            if self.sure[state]:
                return 1
            if not self.sets[state]:
                return 0
        return self.value[state]


@dataclass
class Model:
    """Terms, weights, and words of clean documents that only look like terms."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=PRIOR.copy)
    lookalikes: list[str] = field(default_factory=list)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        match, not_one = LexiconAutomaton(model.terms).match, frozenset(model.lookalikes)
        known = lambda w: 0 if w in not_one else match(w)
        self.kind = _Memo(lambda w: known(w) if w.isalpha() else min(filter(None, map(known, [w, *_LETTERS.findall(w)])), default=0), REMEMBERED)

    def hits(self, text: str) -> list[tuple[str, int, bool]]:
        """(word, kind, whether it is quoted) of each hit in ``text``."""
        low = text.lower()
        if not any(map(self.kind.__getitem__, set(_WORD.findall(low)))):
            return []
        found = [(m, k) for m in _WORD.finditer(low) if (k := self.kind[m[0]])]
        return [(m[0], k, quoted(low, m.start(), m.end())) for m, k in found]

    def features(self, text: str) -> list[float]:
        hits = self.hits(text)
        sure, others = sum(k == 1 and not q for _, k, q in hits), sum(q for *_, q in hits)
        near = sum(k == 2 and not q for _, k, q in hits)
        any_hit = 1.0 if sure else MISSPELLED if near else 0.0
        return [1.0, any_hit, float(np.log1p(sure + MISSPELLED * near)), float(np.log1p(others))]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(text)), -500, 500))))


def quoted(text: str, start: int, end: int) -> bool:
    """Whether marks enclose the hit within the window, or a reporting word stands just before it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    marks = [c for c in before if c in OPENING or c in CLOSING]
    if marks and marks[-1] in OPENING and (marks[-1] != '"' or marks.count('"') % 2) and any(c in CLOSING for c in after):
        return True
    return bool(REPORTING & set(_WORD.findall(before)[-3:]))


def _half(text: str) -> int:
    """One of two halves of the sample; copies of a text share theirs."""
    return zlib.crc32(text.encode()) & 1


def _examples(rows: list[tuple[str, int]], model: Model, alike: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels to fit on.

    Clean rows show false hits as a new document would: without the lookalikes found in their own half. Misspellings are rare among labels, or
    absent, so they have no weights of their own.
    """
    scorer, others = model.scorer(), [Model(model.terms, model.weights, words).scorer() for words in alike]
    return np.array([(scorer if y else others[1 - _half(t)]).features(t) for t, y in rows]), np.array([float(y) for _, y in rows])


def _by_chance(k: int, n: int, share: float) -> float:
    """How likely ``k`` or more of ``n`` are on a side that has ``share`` of all."""
    if not n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)
    return min(1.0, sum(math.exp(log(i)) for i in range(k, n + 1)))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Lexicon and weights from (text, label) rows.

    A term counts by the different words before it, not by documents: copies of one
    toxic document repeat its words, but insults turn up in many surroundings. What clean documents quote
    does not speak against a term. A misspelled hit counts ``MISSPELLED`` of an exact one, whatever the labels.
    """
    n_toxic = sum(y for _, y in rows)
    if not n_toxic or n_toxic == len(rows):
        return Model()
    halves: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in rows:
        if not y:
            words = set(_WORD.findall(_QUOTED.sub(" ", text.lower())))
            halves[_half(text)].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
    clean = halves[0] + halves[1]
    around, docs, more, every = defaultdict(set), Counter(), defaultdict(set), set()
    most = max(0.02 * (len(rows) - n_toxic) / n_toxic, 1e-9)  # clean documents a term may have for each toxic one
    for text, y in rows:
        if y:
            words, seen = _WORD.findall(text.lower()), set()
            every.update(words)
            for before, w in zip(["", *words], words, strict=False):
                for t in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)):
                    if clean[t] <= most * n_toxic * 0.05:
                        around[t].add(before)
                        seen.add(t)
                        if t[-1] == "*":
                            more[t].add(w)
            docs.update(seen)
    least = max(4, 0.01 * n_toxic)
    # Of the many words of toxic documents some stand in no clean one by chance: the terms kept are the ones of least chance, as long as
    # no more than a small share of them is expected to be chance (the rule of Benjamini and Hochberg).
    chance = {t: _by_chance(k, k + clean[t], n_toxic / len(rows)) for t, a in around.items() if (k := min(len(a), docs[t])) >= least and clean[t] <= most * docs[t]}
    ranked = sorted(chance.values())
    bound = max((p for i, p in enumerate(ranked, 1) if p <= BY_CHANCE * i / len(every)), default=-1.0)
    good = {t: len(around[t]) for t, p in chance.items() if p <= bound}
    stems = {t for t in good if t[-1] == "*" and len(more[t]) >= CONTINUATIONS}
    for t in sorted(stems, key=len, reverse=True):  # the longest stem that has its shorter one's support stands for both
        if t[:-2] + "*" in stems and t in stems:
            if good[t] >= 0.7 * good[t[:-2] + "*"]:
                stems.discard(t[:-2] + "*")
    for t in sorted(stems, key=len):
        if any(t[:k] + "*" in stems for k in range(1, len(t) - 1)):
            stems.discard(t)
    words = {t for t in good if t[-1] != "*"}  # those a stem covers too, as a stem has no misspellings
    model = Model(sorted(stems | words))
    match = LexiconAutomaton(model.terms).match
    alike = Counter({w: n for w, n in clean.items() if w[-1] != "*" and not docs[w] and match(w)})
    x, y = _examples(rows, model, [[w for w in alike if half[w]] for half in halves])
    model.lookalikes = sorted(alike)
    prior = np.array(PRIOR)
    loss = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + 0.25 * ((w - prior) ** 2).sum()
    w = prior.copy()
    for _ in range(100):  # Newton's method, steps halved until they help, with a small ridge around the prior weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (y - p) - 0.5 * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = [float(v) for v in w]
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents outside the held-out fold: of either class those of least hash,
    at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``, in one task. Only labels and the sample's rows move.
    """
    known = labels.where((fold() != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = by_hash(1, SAMPLE_TOXIC).unionByName(by_hash(0, SAMPLE_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids

    def work(batches):
        texts = {}
        for b in batches:
            for doc_id, text, y in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                texts[doc_id, text or ""] = int(y)
        model = fit([(t, y) for (_, t), y in sorted(texts.items())])
        yield {"model": [json.dumps([model.terms, model.weights, model.lookalikes])]}

    found = map_batches(rows.select("doc_id", "text", "toxic").repartition(1), work, "model string").first()
    return Model(*json.loads(found["model"])) if found else Model()


def score_documents(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see the contract of ``op4_toxicity``.

    Only ``text`` enters a score. Null and empty texts score as texts without hits; equal texts
    score equally, repeated rows and null doc_ids pass through; without labels a fixed model with an
    empty lexicon scores. An empty table gives no rows. Scoring shuffles nothing.
    """
    model = model or (learn(docs, labels) if labels is not None else Model())

    def work(batches):
        scorer = model.scorer()
        for whole in batches:
            for b in slices(whole, "text"):
                scores = [scorer.score(t or "") for t in b["text"].to_pylist()]
                yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    rows = docs.select("doc_id", "text", (fold() == 0).alias("held_out"))
    return map_batches(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, that the score does not reject. Nothing but training moves rows.

    Null and empty texts stay, as texts without hits; of repeated rows all stay or none; null doc_ids make no difference, an
    empty table gives no rows, and without labels the fixed model rejects nothing.
    """
    model = learn(docs, labels)
    cached: list[Scorer] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not cached:
            cached.append(model.scorer())
        return texts.fillna("").map(cached[0].score).astype(float)

    return docs.where(score(F.col("text")) < 0.5)
