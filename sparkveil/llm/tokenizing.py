"""Byte-level BPE ids of texts, pre-token by pre-token.

The tokenizer never merges across pre-tokens, so each distinct pre-token is encoded once and its
ids are kept in a bounded cache. Texts of Latin letters are cut by an equivalent pattern of the
standard library; other texts go through the tokenizer's own splitting.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

CACHE_WORDS = 100_000
LATIN_END = 0x250
#: The special token of the vocabulary and the pre-token pattern of byte-level BPE.
SPECIAL = "<|endoftext|>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _charset(kind: str) -> str:
    """The Latin code points of a Unicode class, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


def _latin_pattern() -> re.Pattern:
    letter, number, space = _charset("L"), _charset("N"), r" \t\n\r\x0b\x0c\x85\xa0"
    return re.compile(
        PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]")
        .replace(r"\p{N}", f"[{number}]").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
    )


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, by their public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Pre-token -> little-endian uint32 ids; full caches are emptied, so memory is bounded."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
        alphabet = _byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, token)): rank for token, rank in vocabulary.items() if token != SPECIAL}
        self.special = {SPECIAL: added[SPECIAL]} if SPECIAL in added else {}
        self.bpe = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.latin = _latin_pattern()
        self.foreign = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = np.array(self.bpe.encode_ordinary(word), "<u4").tobytes()
        return out

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens; joined they give the text."""
        if self.foreign.search(text):
            import regex

            return regex.findall(PATTERN, text)
        return self.latin.findall(text)

    def ids(self, text: str) -> bytes:
        """The ids of the whole text, as the tokenizer gives them without added special tokens."""
        if not text:
            return b""
        if self.special and SPECIAL in text:
            mark = np.array([self.special[SPECIAL]], "<u4").tobytes()
            return mark.join(self.ids(part) for part in text.split(SPECIAL))
        if self.foreign.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        return b"".join([self[w] for w in self.latin.findall(text)])


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One cache for each vocabulary and Python worker."""
    return Words(path)
