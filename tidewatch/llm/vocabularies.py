"""Where tokenizer files are, and byte-level tables."""

from __future__ import annotations

from functools import lru_cache


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, int]:
    """Code point that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others follow from 256 on."""
    table, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[b] = b
        else:
            table[b], extra = extra, extra + 1
    return table


@lru_cache(maxsize=4)
def load(path: str):
    """A tokenizer of the tokenizers library, with truncation and padding off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok
