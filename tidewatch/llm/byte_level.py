"""Byte-level BPE ids of whole texts, by chunks that are encoded once each.

A text is cut before every single space: there the pre-tokenizer's pattern ends
a piece in any case, so the chunks' ids joined are the text's ids. Texts where
white space stands on both sides of a space, or that hold a special token, go
through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

from tidewatch.llm.vocabularies import byte_characters, load, tokenizer_path

#: Chunks that a worker remembers at most; the older half is forgotten beyond that.
REMEMBERED = 500_000
#: Characters of a key from which it is not remembered, and of all keys of a memo: what texts without spaces may take is bounded.
LONGEST, CHARACTERS = 64, 1 << 23

#: The pre-tokenizer's pattern (a fixed value of byte-level vocabularies of this kind).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_DENSE_SPACE = re.compile(r"\s (?:\s|$)")


class _Memo(dict):
    """A dict that computes what it misses, and forgets the older half when it has ``most`` entries or ``CHARACTERS`` of keys; long keys it never keeps."""

    def __init__(self, make, most: int, length=len):
        super().__init__()
        self.make, self.most, self.length, self.held = make, most, length, 0

    def __missing__(self, key):
        value, n = self.make(key), self.length(key)
        if n > LONGEST:
            return value
        self[key] = value
        self.held += n
        if len(self) > self.most or self.held > CHARACTERS:
            for old in list(self)[: len(self) // 2 + 1]:
                del self[old]
            self.held = sum(map(self.length, self))
        return value


class ByteLevelEncoder:
    """``encode(text)`` gives little-endian unsigned ids of ``self.dtype``."""

    def __init__(self, path: str):
        import regex

        self.tok = load(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        plain = (
            kind.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
        )
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.plain = plain
        table, tokenize, find = byte_characters(), self.tok.model.tokenize, regex.compile(PIECES).findall
        code, space = "H" if self.dtype.itemsize == 2 else "I", " ".translate(table)

        def ids_of(mapped: str) -> bytes:
            return array(code, [t.id for t in tokenize(mapped)]).tobytes()

        def piece(p: str) -> bytes:
            return ids_of(p.encode().decode("latin-1").translate(table))

        def join(text: str) -> bytes:
            return b"".join(map(self.pieces.__getitem__, find(text)))

        def chunk(c: str) -> bytes | None:
            """Ids of a chunk behind a space; None where white space follows that space."""
            if c.isalpha():
                return ids_of(space + c) if c.isascii() else piece(" " + c)
            if not c or c[0].isspace():
                return None
            if c[-1] in ",." and c[:-1].isalpha():
                return self.chunks[c[:-1]] + self.pieces[c[-1]]
            return join(" " + c)

        self.pieces = _Memo(piece, REMEMBERED // 4)
        self.heads, self.chunks, self.after_space = _Memo(join, REMEMBERED // 8), _Memo(chunk, REMEMBERED), lambda c: join(" " + c)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.plain and not any(t in text for t in self.special):
            head, *rest = text.split(" ")
            ids = [self.heads[head], *map(self.chunks.__getitem__, rest)]
            try:
                return b"".join(ids)
            except TypeError:  # white space behind some space
                ids = ids[1:]
            if not _DENSE_SPACE.search(text):
                return self.heads[head] + b"".join(self.after_space(c) if i is None else i for c, i in zip(rest, ids, strict=True))
        return array("H" if self.dtype.itemsize == 2 else "I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def encoder(name: str) -> ByteLevelEncoder:
    """The worker's encoder for the tokenizer file ``name``; it lasts over tasks."""
    return ByteLevelEncoder(tokenizer_path(name))
