"""BPE encoding by forced boundaries, and decoding.

Two neighbouring symbols that stand next to each other inside no token of the vocabulary
can never be joined by a merge. Between them a cut is certain: the merges on either
side are independent, so fragments are encoded alone (once each) and their ids are
concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame

from tidewatch.llm._common import map_batches, slices
from tidewatch.llm.byte_level import REMEMBERED, _Memo
from tidewatch.llm.vocabularies import byte_characters, load, tokenizer_path

TOKENIZER = "word_bpe_49k.json"


class ForcedBoundaryBPE:
    """Encodes as the tokenizer file's model does, for vocabularies whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        model = kind["model"]
        self.tok, self.vocab, self.end = load(path), model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        from tokenizers import models

        #: Models for fragments that end a word, and for those that don't.
        self.last, self.inner = self.tok.model, models.BPE(vocab=self.vocab, merges=merges)
        self.simple = self._simple(kind)
        self.inside = {p for token in self.vocab for p in self._neighbours(token)}
        self.token = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        added = {t["content"]: t["id"] for t in kind.get("added_tokens", [])}
        self.added, self.special = added, re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.fragments = _Memo(self._merge, REMEMBERED, lambda f: len(f[0]))
        self.words = _Memo(self._word, REMEMBERED // 2)
        self.chunks = _Memo(self._chunk, REMEMBERED)

    def _simple(self, kind: dict):
        """The splitting pattern, if ASCII text needs only lower case before it."""
        import regex

        self.table = byte_characters()
        normal = [n["type"] for n in (kind.get("normalizer") or {}).get("normalizers", [])]
        before = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [b["type"] for b in before] != ["Split", "ByteLevel"]:
            return None
        split, level = before
        if not (split.get("invert") and split["behavior"] == "Removed") or level["use_regex"] or level["add_prefix_space"]:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _symbols(self, token: str, last: bool) -> list[str]:
        out = list(token)
        if last and out:
            out[-1] += self.end
        return out

    def _neighbours(self, token: str):
        """Pairs of symbols that stand next to each other in ``token``."""
        ends = bool(self.end) and token.endswith(self.end)
        s = self._symbols(token[: len(token) - len(self.end)] if ends else token, ends)
        return zip(s, s[1:], strict=False)

    def cut(self, word: str) -> list[tuple[str, bool]]:
        """Fragments of a word between certain cuts, and whether each ends the word."""
        s, out, start = self._symbols(word, True), [], 0
        for i in range(1, len(s)):
            if (s[i - 1], s[i]) not in self.inside:
                out.append((word[start:i], False))
                start = i
        return [*out, (word[start:], True)]

    def _merge(self, fragment: tuple[str, bool]) -> tuple[int, ...]:
        """Ids of one fragment, by the merges alone."""
        return tuple(t.id for t in (self.last if fragment[1] else self.inner).tokenize(fragment[0]))

    def _word(self, word: str) -> tuple[int, ...]:
        return tuple(i for f in self.cut(word) for i in self.fragments[f])

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the tokens of a stretch without white space around it."""
        if self.simple and chunk.isascii():
            pieces = [p.translate(self.table) for p in self.simple.findall(chunk.lower())]
        else:
            normal = self.tok.normalizer.normalize_str(chunk) if self.tok.normalizer else chunk
            pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]
        ids = [i for p in pieces for i in self.words[p]]
        return len(ids), " ".join(map(str, ids)), " ".join(self.token[i] for i in ids)

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by spaces, and the text that decoding them gives."""
        got = []
        for part in self.special.split(text) if self.special and self.special.search(text) else [text]:
            if part in self.added:
                got.append((1, str(self.added[part]), part))
            else:
                got += map(self.chunks.__getitem__, part.replace("\n", " ").split(" "))
        got = [x for x in got if x[0]]
        return sum(x[0] for x in got), " ".join(x[1] for x in got), self.joined([x[2] for x in got])

    @staticmethod
    def joined(tokens: list[str]) -> str:
        """A tokenizer file without a decoder joins the tokens by single spaces."""
        return " ".join(tokens)

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return self.joined([self.token[i] for i in ids if i in self.token])


@lru_cache(maxsize=2)
def coder(name: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(tokenizer_path(name))


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, digest: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) of every document; with ``digest`` (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null texts count as empty ones and give no ids. Rows are independent of each other, so
    repeated rows and null doc_ids pass through; other columns are ignored. Nothing is shuffled.
    """

    def work(batches):
        bpe = coder(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for b in slices(whole, "text"):
                out = defaultdict(list)
                for text in b["text"].to_pylist():
                    n, ids, decoded = bpe.encode(text or "")
                    if digest:
                        out["n_tokens"].append(n)
                        out["ids_sha256"].append(sha(ids))
                        out["decoded_sha256"].append(sha(decoded))
                    else:
                        out["ids"].append([int(i) for i in ids.split()])
                        out["decoded"].append(decoded)
                yield out | {"doc_id": b["doc_id"]}

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id long, {columns}")
