"""Coin addresses: published examples, and every single changed character is found."""

import pytest

from sparkveil.operators import checksums as c


@pytest.mark.parametrize("text", ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy"])
def test_base58check(text):
    assert c.base58check(text) and not c.base58check(text[:-1]) and not c.base58check("0" + text)
    assert not any(c.base58check(text[:i] + ("2" if text[i] != "2" else "3") + text[i + 1 :]) for i in range(1, len(text)))


@pytest.mark.parametrize("text", ["bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"])
def test_bech32(text):
    low = text.lower()
    assert c.bech32(text) and not c.bech32(low[:-7]) and not c.bech32(low.replace("1", ""))
    assert not any(c.bech32(low[:i] + ("q" if low[i] != "q" else "p") + low[i + 1 :]) for i in range(3, len(low)))
