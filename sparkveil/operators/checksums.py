"""Checksums of coin addresses, for strings that already have the form of one."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Fixed values of the two standards: alphabets, the generator of bech32 and its two final values.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
FINAL = (1, 0x2BC830A3)


def base58check(text: str) -> bool:
    """25 bytes in base 58, of which the last four are the start of the double SHA-256 of the others."""
    if not text or any(c not in BASE58 for c in text):
        return False
    value = sum(BASE58.index(c) * 58**i for i, c in enumerate(reversed(text)))
    if value >> 200:
        return False
    raw = value.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def bech32(text: str) -> bool:
    """A readable part, the last ``1`` and at least six symbols whose polynomial remainder is one of the final values."""
    head, one, data = text.lower().rpartition("1")
    if not one or not head or len(data) < 6 or any(c not in BECH32 for c in data):
        return False
    rest = 1
    for v in [*(ord(c) >> 5 for c in head), 0, *(ord(c) & 31 for c in head), *map(BECH32.index, data)]:
        carry, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            rest ^= g * (carry >> i & 1)
    return rest in FINAL


@F.pandas_udf(BooleanType())
def coin_address(text: pd.Series) -> pd.Series:
    """Whether strings pass the check of the form they have; apply to matches of the forms alone."""
    return text.map(lambda t: bool(t) and (base58check(t) or bech32(t))).astype(bool)
