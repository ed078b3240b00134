"""Hashes of the words of a text, whole arrays at a time."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once; a word may reach beyond.
BLOCK = 1 << 20
_BYTE = np.random.default_rng(10).integers(0, 2**64, 256, np.uint64)
#: The golden-ratio increment here and, in mix(), the multipliers of the public SplitMix64 generator.
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, _INVERSE)):
            run = np.full(2 * n, base, np.uint64)
            run[0] = 1
            _POWERS[i] = np.cumprod(run, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (a run without ASCII white space), in order: a sum of byte values times powers, from
    running sums over the bytes."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        part = np.frombuffer(raw[at:end], np.uint8)
        gap = np.concatenate([[True], (part == 32) | ((part >= 9) & (part <= 13)), [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)])
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
