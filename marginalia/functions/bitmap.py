"""A compressed bitmap of 32-bit ordinals.

Ordinals are split by their upper 16 bits into containers.  A container with up
to 4,096 members keeps a sorted array of 16-bit values; a fuller one keeps a
65,536-bit set.  Set operations work container by container.
"""

from __future__ import annotations

import numpy as np

_ARRAY_MOST = 4096
_WORDS = 1024


def _to_bits(values: np.ndarray) -> np.ndarray:
    flags = np.zeros(_WORDS * 64, dtype=np.uint8)
    flags[values] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _from_bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).astype(np.uint16)


def _pack(values: np.ndarray) -> np.ndarray:
    return values if len(values) <= _ARRAY_MOST else _to_bits(values)


def _is_bits(c: np.ndarray) -> bool:
    return c.dtype == np.uint64


def _values(c: np.ndarray) -> np.ndarray:
    return _from_bits(c) if _is_bits(c) else c


def _contains(c: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` the container ``c`` holds."""
    if _is_bits(c):
        return (c[values >> 6] >> (values & 63).astype(np.uint64)) & np.uint64(1) == 1
    at = np.searchsorted(c, values)
    at[at == len(c)] = 0
    return c[at] == values


class CompressedBitmap:
    """An immutable set of ordinals in [0, 2**32)."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self._c = containers or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> CompressedBitmap:
        ordinals = np.unique(np.asarray(ordinals, dtype=np.uint32))
        high = ordinals >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(ordinals, cuts) if len(ordinals) else []
        return cls({int(p[0] >> 16): _pack((p & 0xFFFF).astype(np.uint16)) for p in parts})

    def and_not(self, other: CompressedBitmap) -> CompressedBitmap:
        out = {}
        for k, a in self._c.items():
            b = other._c.get(k)
            if b is None:
                out[k] = a
                continue
            if _is_bits(a) and _is_bits(b):
                left = _from_bits(a & ~b)
            else:
                values = _values(a)
                left = values[~_contains(b, values)]
            if len(left):
                out[k] = _pack(left)
        return CompressedBitmap(out)

    def and_(self, other: CompressedBitmap) -> CompressedBitmap:
        out = {}
        for k in self._c.keys() & other._c.keys():
            a, b = self._c[k], other._c[k]
            if _is_bits(a) and _is_bits(b):
                both = _from_bits(a & b)
            else:
                if _is_bits(a):
                    a, b = b, a
                both = a[_contains(b, a)]
            if len(both):
                out[k] = _pack(both)
        return CompressedBitmap(out)

    def ordinals(self) -> np.ndarray:
        parts = [(np.uint32(k) << np.uint32(16)) | _values(c).astype(np.uint32) for k, c in sorted(self._c.items())]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def __len__(self) -> int:
        return sum(int(np.unpackbits(c.view(np.uint8)).sum()) if _is_bits(c) else len(c) for c in self._c.values())

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self._c.values())
