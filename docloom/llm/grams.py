"""Names of byte strings by doubling, for whole Arrow batches of text at once.

The name of 2h bytes at a place is made of the pair of names of h bytes at the place and h bytes
later (Karp, Miller and Rosenberg), mixed to 64 bits. Equal strings have equal names wherever they
stand; two families of names together make 128 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Window of grams' low bits that hold a place; a chunk is no longer than this.
PLACE = 20
_rng = np.random.default_rng(20240229)
BYTE_NAMES = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
MIXERS = _rng.integers(0, 2**63, (2, 12), dtype=np.uint64) * U(2) + U(1)
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray, family: int, step: int) -> np.ndarray:
    """The name of a rank pair."""
    x = a * MIXERS[family, step] + b
    return x ^ (x >> U(29))


def doubled(data: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Names of all strings of ``length`` (a power of two) bytes; empty if ``data`` is shorter."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    names, n, step = BYTE_NAMES[family][data], 1, 0
    while n < length:
        names = pair(names[:-n], names[n:], family, step)
        n, step = 2 * n, step + 1
    return names


def at_length(names: np.ndarray, have: int, length: int, places: np.ndarray, family: int = 0) -> np.ndarray:
    """Names of ``length`` bytes (have <= length <= 2 * have) at places, from names of ``have`` bytes."""
    return mix64(pair(names[places], names[places + (length - have)], family, 11))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE, BASE_INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2^64 and of its inverse, at least n of each."""
    if n not in _powers:
        out = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(n, base)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[n] = tuple(out)
    return _powers[n]


def prefix_sums(values: np.ndarray, room: int) -> np.ndarray:
    """Running sums of value x base^place; ``room`` is at least len(values)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(room)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, room: int) -> np.ndarray:
    """Names of data[start:end], alike at any place."""
    return mix64((sums[end] - sums[start]) * powers(room)[1][start] + (end - start).astype(np.uint64) * MIX_B)


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans by owner (any int64); spans that touch become one."""
    if not len(start):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    group = np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
    high = np.int64(1) << 40
    reach = np.maximum.accumulate(end + group * high) - group * high
    opens = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:] - 1, len(start) - 1]
    return owner[first], start[first], reach[last]
