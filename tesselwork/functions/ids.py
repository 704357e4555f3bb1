"""Object identifiers: random bytes as Crockford base 32 text."""

from __future__ import annotations

import os

# Fixed value: the digits of Crockford's base 32.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def encode(raw: bytes) -> str:
    bits, n = int.from_bytes(raw, "big"), len(raw) * 8
    length = -(-n // 5)
    bits <<= length * 5 - n
    return "".join(DIGITS[bits >> 5 * i & 31] for i in reversed(range(length)))


def decode(text: str, size: int) -> bytes:
    bits = 0
    for c in text.upper():
        bits = bits << 5 | DIGITS.index({"O": "0", "I": "1", "L": "1"}.get(c, c))
    return (bits >> len(text) * 5 - size * 8).to_bytes(size, "big")


def new_id(size: int = 12) -> str:
    return encode(os.urandom(size))
