"""A compressed full-text index over sequences of words.

The texts of a shard are joined, each behind a separator, and kept as the
Burrows-Wheeler transform of their word numbers with the text of every suffix.
Rank queries are answered from the sorted positions of each word in the transform, so
a backward step for a whole batch of patterns is two binary searches.
"""

from __future__ import annotations

import zlib

import numpy as np

SEPARATOR = 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ends count as smaller than any symbol."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] if step < n else []
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        rank = new
        if rank[order[-1]] == n or step >= n:
            return order
        step *= 2


class FMIndex:
    def __init__(self, words: list[str], bwt: np.ndarray, text_of_row: np.ndarray, texts: np.ndarray):
        self.words, self.bwt, self.text_of_row = words, bwt, text_of_row
        self.texts = texts  # the joined texts, to extend a match that was found
        self.text_ends = np.flatnonzero(texts == SEPARATOR)
        self.number = {w: i + 1 for i, w in enumerate(words)}
        self.n = len(bwt)
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=len(words) + 1))]).tolist()  # rows before those of each symbol
        self._keys: np.ndarray | None = None

    @classmethod
    def build(cls, texts: list[list[str]]) -> FMIndex:
        words = sorted({w for t in texts for w in t})
        number = {w: i + 1 for i, w in enumerate(words)}
        symbols = np.array([s for t in texts for s in (*(number[w] for w in t), SEPARATOR)], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        order = suffix_array(symbols)
        return cls(words, symbols[order - 1].astype(np.int32), text[order].astype(np.int32), symbols.astype(np.int32))

    @property
    def keys(self) -> np.ndarray:
        """(symbol, position) of the transform in one number, sorted: the position of a key is where a backward step lands."""
        if self._keys is None:
            key = self.bwt.astype(np.int64) * (self.n + 1) + np.arange(self.n)
            key.sort()
            self._keys = key
        return self._keys

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the rows that begin with ``symbol`` before what [low, high) began with."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def rows(self, word: str) -> tuple[int, int]:
        """The interval of rows that begin with ``word``: one backward step from all rows."""
        symbol = self.number.get(word)
        return (0, 0) if symbol is None else (self.begins[symbol], self.begins[symbol + 1])

    def count(self, word: str) -> int:
        low, high = self.rows(word)
        return high - low

    def text(self, k: int) -> list[str]:
        """The words of the text number ``k``."""
        begin = self.text_ends[k - 1] + 1 if k else 0
        return [self.words[s - 1] for s in self.texts[begin : self.text_ends[k]].tolist()]

    def maximal_matches(self, patterns: list[list[str]]) -> tuple[np.ndarray, ...]:
        """Streams patterns through backward search and cuts each into maximal matches, from its end.

        A match is extended to the left as long as some text has it; where it ends, the next one
        begins.  Words no text has are left out.  Returns, one row a match: pattern, first word, word
        behind the last, and the interval of rows that begin with it.
        """
        m = len(patterns)
        lengths = np.array([len(p) for p in patterns], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.array([self.number.get(w, -1) for p in patterns for w in p], dtype=np.int64)
        left = lengths.copy()  # words not yet read
        end = lengths.copy()  # where the match under way ends
        low, high = np.zeros(m, dtype=np.int64), np.full(m, self.n, dtype=np.int64)
        found: list[tuple[np.ndarray, ...]] = []

        def close(rows: np.ndarray) -> None:
            rows = rows[end[rows] > left[rows]]
            found.append((rows, left[rows].copy(), end[rows].copy(), low[rows].copy(), high[rows].copy()))

        active = np.flatnonzero(left > 0)
        while len(active):
            symbol = flat[starts[active] + left[active] - 1]
            lo, hi = self.step(np.maximum(symbol, 0), low[active], high[active])
            grows = (symbol >= 0) & (lo < hi)
            on, off = active[grows], active[~grows]
            low[on], high[on] = lo[grows], hi[grows]
            left[on] -= 1
            close(off)
            alone = end[off] == left[off]  # not even this word alone: leave it out
            left[off[alone]] -= 1
            end[off] = left[off]
            low[off], high[off] = 0, self.n
            done = left[active] == 0
            close(active[done])
            active = active[~done]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))

    def to_bytes(self) -> bytes:
        """Compressed: the transform puts equal words next to each other."""
        head = "\n".join(self.words).encode()
        parts = [zlib.compress(p, 6) for p in (head, self.bwt.tobytes(), self.text_of_row.tobytes(), self.texts.tobytes())]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        parts, at = [], 0
        for _ in range(4):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(zlib.decompress(data[at + 8 : at + 8 + size]))
            at += 8 + size
        words = parts[0].decode().split("\n") if parts[0] else []
        return cls(words, np.frombuffer(parts[1], dtype=np.int32), np.frombuffer(parts[2], dtype=np.int32), np.frombuffer(parts[3], dtype=np.int32))
