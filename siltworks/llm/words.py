"""Vectorised hashing of words and word windows, shared by the operators that work on word sequences."""

from __future__ import annotations

import numpy as np

#: The six characters between words; UTF-8 never uses these bytes inside another character.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ONE = np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (shift, multiply, twice)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


#: One multiplier per place in a word; from then on, multipliers are computed.
_PLACES = stream(1, 1 << 12) | _ONE


def hash_words(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    a = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[a]
    b = a[inside]
    if not len(b):
        return np.zeros(0, np.uint64)
    first = np.empty(len(a), bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    begins = np.flatnonzero(first[inside])
    sizes = np.diff(np.append(begins, len(b)))
    place = np.arange(len(b)) - np.repeat(begins, sizes)
    if sizes.max() > len(_PLACES):
        far = place >= len(_PLACES)
        factors = _PLACES[np.where(far, 0, place)]
        factors[far] = mix64((place[far].astype(np.uint64) + _ONE) * np.uint64(0x9E3779B97F4A7C15)) | _ONE
    else:
        factors = _PLACES[place]
    sums = np.add.reduceat((b.astype(np.uint64) + _ONE) * factors, begins)
    return mix64(sums + sizes.astype(np.uint64))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words begin and end."""
    a = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~_SPACE[a]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def window_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each window of n consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j, m in enumerate(stream(seed, n) | _ONE):
        out += words[j : j + count] * m
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of width entries, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
