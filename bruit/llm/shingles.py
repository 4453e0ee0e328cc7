"""Shingle sets of texts as sorted arrays of 64-bit hashes, computed with numpy over the text's bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=_U)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ _U(salt)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        size = max(n, 1 << 16)
        full = np.full(size, base, _U)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, with A-Z as a-z."""
    if not text:
        return np.zeros(0, _U)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw], [True]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[raw] * _powers_of(_BASE, len(raw)), dtype=_U)])
    # A word's sum, moved to offset 0, doesn't depend on where it stands.
    moved = (sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(raw) + 1)[starts]
    return mix(moved + (ends - starts).astype(_U))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words make one shingle, no word none."""
    w = word_hashes(text)
    n = min(k, len(w))
    if not n:
        return w
    out = np.zeros(len(w) - n + 1, _U)
    for i in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + w[i : len(w) - n + 1 + i]
    return np.unique(mix(out, n))


def sum64(x: np.ndarray) -> int:
    return int(np.add.reduce(x, dtype=_U)) if len(x) else 0


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x
