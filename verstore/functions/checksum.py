"""CRC-32 of a concatenation from the parts' checksums."""

from __future__ import annotations

#: Fixed value: the reflected CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's (bit 31 is x^0)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


def combined(first: int, second: int, second_length: int) -> int:
    """crc32(a + b) from crc32(a), crc32(b) and len(b): first times x^(8 n)."""
    power, square, n = 1 << 31, 1 << 23, second_length
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second
