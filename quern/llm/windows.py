"""Hashes of all windows of many texts at once, in numpy: the columnar core of the span operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_POSITION_BITS = 28
_MASK = np.uint64((1 << _POSITION_BITS) - 1)
#: fixed values: odd multipliers of the hash
_BASE, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PRIME = (1 << 61) - 1
_P, _LOW_31, _LOW_30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_1, _30, _31, _61 = (np.uint64(n) for n in (1, 30, 31, 61))
SLICE_CHARS = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(_MIX_1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(_MIX_2)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """Window hashes modulo 2**64 over randomly mapped code points; equal windows have equal hashes wherever they stand.
    Different windows can have equal hashes (some texts of 1,024 characters do), so they serve to choose candidates only."""

    def __init__(self) -> None:
        self._low = self._map(np.arange(0x3000))
        self._grow(1 << 16)

    def _map(self, codes: np.ndarray) -> np.ndarray:
        return _mix(codes.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x1234567))

    def _grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        self._up, self._down = np.cumprod(up), np.cumprod(down)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) + 1 > len(self._up):
            self._grow(2 * len(codes) + 1)
        mapped = self._low[codes] if codes.dtype == np.uint8 or not len(codes) or codes.max() < len(self._low) else self._map(codes)
        mapped = mapped * self._up[: len(codes)]
        sums = np.empty(len(codes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(mapped, out=sums[1:])
        return sums

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """The hash of ``[i, i + length)`` for every ``i``."""
        if len(prefix) <= length:
            return np.empty(0, np.uint64)
        h = prefix[length:] - prefix[:-length]
        h *= self._down[: len(h)]
        return _mix(h)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo PRIME, all below it: 31-bit halves, and 2**61 is 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW_31, b >> _31, b & _LOW_31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _1) + (middle >> _30) + ((middle & _LOW_30) << _31) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


class PrimeHasher:
    """Window hashes modulo a prime at a base drawn at random: two different windows of length n are equal with a
    probability of at most n / 2**61, whatever the texts are."""

    def __init__(self, base: int) -> None:
        self._base, self._inverse = base, pow(base, -1, PRIME)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, _times(have, np.full(len(have), pow(base, len(have), PRIME), np.uint64))])
        return have

    def windows(self, codes: np.ndarray, length: int) -> np.ndarray:
        """The hash of ``[i, i + length)`` for every ``i``."""
        n = len(codes) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._up, self._down = self._powers(self._up, self._base, len(codes)), self._powers(self._down, self._inverse, n)
        terms = _times(codes.astype(np.uint64) + np.uint64(1), self._up[: len(codes)])
        sums = np.zeros(len(codes) + 1, np.uint64)
        # sums of 31-bit halves cannot overflow
        low, high = np.cumsum(terms & _LOW_31), np.cumsum(terms >> _31)
        sums[1:] = _reduced(_times(_reduced(high), np.full(1, 1 << 31, np.uint64)) + _reduced(low))
        return _times(_reduced(sums[length:] + _P - sums[:-length]), self._down[:n])


def lowest(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``i``, where the lowest hash of ``[i, i + width)`` stands; the first of equal ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    keys = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
    if width > 1:
        padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        keys = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (keys & _MASK).astype(np.int64)


def slices(texts: pa.Array, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(first row, starts, code points, base)`` of consecutive rows with about SLICE_CHARS characters together.

    ``starts`` has one entry more than rows. A longer text comes alone, in pieces of SLICE_CHARS characters and
    ``overlap`` more, ``base`` being the piece's place in it; else ``base`` is 0. Null is an empty text."""
    lengths = np.asarray(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lengths)
    a = 0
    while a < len(texts):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")))
        data = "".join(t or "" for t in texts.slice(a, b - a).to_pylist())
        codes = np.frombuffer(data.encode("ascii"), np.uint8) if data.isascii() else np.frombuffer(data.encode("utf-32-le"), np.uint32)
        if len(codes) > SLICE_CHARS:
            for base in range(0, max(1, len(codes) - overlap), SLICE_CHARS):
                piece = codes[base : base + SLICE_CHARS + overlap]
                yield a, np.array([0, len(piece)]), piece, base
        else:
            yield a, np.concatenate(([0], np.cumsum(lengths[a:b]))), codes, 0
        a = b
