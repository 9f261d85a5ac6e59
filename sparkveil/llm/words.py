"""Words and their hashes for whole texts, as numpy arrays over the text's UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64, prefix_hash, slice_hash, symbol_table

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOLS = symbol_table(101)[_LOWER]


def alnum_bytes() -> np.ndarray:
    """Bytes of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower-cased."""
    out = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        out[lo:hi] = True
    return out


def solid_bytes() -> np.ndarray:
    """Bytes of the words [^\\x20\\x09-\\x0D]+."""
    out = np.ones(256, bool)
    out[[32, *range(9, 14)]] = False
    return out


@lru_cache(maxsize=4)
def _kind(name: str) -> np.ndarray:
    return {"alnum": alnum_bytes, "solid": solid_bytes}[name]()


def encode(text: str | None) -> np.ndarray:
    """Lower-cased (A-Z) UTF-8 bytes of a text."""
    return _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]


def word_hashes(raw: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words in ``raw``, in order."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _kind(kind)[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    h = prefix_hash(_SYMBOLS[raw])
    return mix64(slice_hash(h, starts, ends) + (ends - starts).astype(np.uint64)), starts, ends
