"""Vectorised word hashing over the bytes of many texts at once (numpy, used inside Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(7)
#: Random values stand for the bytes, so that words of alike bytes don't give alike sums.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: All bytes but ASCII white space belong to words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    held = _powers[which]
    if len(held) < n:
        base = _BASE if which == "up" else _INVERSE
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _powers[which] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial in odd arithmetic mod 2**64, mixed with the length."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power("up", n), dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts of about ``most`` bytes; a newline ends each text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= most or i == len(texts) - 1:
            some = texts[first : i + 1]
            offsets = np.zeros(len(some) + 1, np.int64)
            np.cumsum([len(x) + 1 for x in some], out=offsets[1:])
            yield first, i + 1, np.frombuffer(b"\n".join(some) + b"\n", np.uint8), offsets
            first, held = i + 1, 0
