"""Byte-pair encoding of a whole column with a published vocabulary.

Each piece of text that the vocabulary's splitting pattern yields is encoded once
per worker and then found again in a table.  The encoding itself keeps a segment
tree over the byte positions of the piece: a leaf holds the rank of the pair that
starts there, an inner node the smaller of its children, ties to the left.  The
root tells the next merge; a merge changes at most three leaves, of the two parts
and of the live neighbour before them, each a path of logarithmic length.  Short
pieces of a batch go through their trees together, as rows of one array; a long
piece has a tree of its own.

Nothing is trained here: the vocabulary is read from the path given.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the splitting pattern published with the vocabulary. White space is
# spelled out because Unicode's property leaves out four controls that \s has in Python.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_NONE = np.int32(2**31 - 1)
_BITS = 20  # of a token id in a pair's key
_TOGETHER = 128  # bytes up to which pieces are encoded in one array
_ROWS = 8192  # pieces in one array
#: Characters of pieces a worker remembers before it forgets them all; bounds memory, never results.
REMEMBERED_CHARS = 24_000_000


class PairRanks:
    """Rank (= id of the merged token) of every pair of tokens whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << _BITS | right)
                    ids.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ids = np.array(ids, dtype=np.int32)[order]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._by_key: dict[int, int] | None = None

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << _BITS | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ids[at], _NONE)

    def one(self) -> dict[int, int]:
        if self._by_key is None:
            self._by_key = dict(zip(self.keys.tolist(), self.ids.tolist()))
        return self._by_key

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_by_key": None}


def read_vocabulary(path: str) -> PairRanks:
    """From a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return PairRanks({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def _encode_together(pieces: list[bytes], leaves: int, ranks: PairRanks) -> list[np.ndarray]:
    """Pieces of 1 to ``leaves`` bytes, a power of two; row r of each array belongs to piece r."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(n, leaves)
    token = ranks.byte_ids[raw]
    place = np.arange(leaves)
    live = place[None, :] < lengths[:, None]
    after = np.broadcast_to(place + 1, (n, leaves)).copy()  # position of the next live node; leaves = none
    before = np.broadcast_to(place - 1, (n, leaves)).copy()
    after[np.arange(n), lengths - 1] = leaves
    tree = np.full((n, 2 * leaves), _NONE, dtype=np.int32)
    if leaves > 1:
        pair = ranks.of(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, leaves - 1)
        tree[:, leaves:-1] = np.where(live[:, 1:], pair, _NONE)
    for level in range(leaves.bit_length() - 1, 0, -1):
        lo = 1 << (level - 1)
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

    def climb(row: np.ndarray, at: np.ndarray) -> None:
        node = (at + leaves) >> 1
        while node[0] > 0:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    row = np.flatnonzero(tree[:, 1] < _NONE)
    while len(row):
        best = tree[row, 1]
        node = np.ones(len(row), dtype=np.int64)
        for _ in range(leaves.bit_length() - 1):  # down to the leftmost leaf of that rank
            node = 2 * node + (tree[row, 2 * node] != best)
        at = node - leaves
        gone = after[row, at]
        then = after[row, gone]
        token[row, at] = best
        live[row, gone] = False
        after[row, at] = then
        has_next = then < leaves
        before[row[has_next], then[has_next]] = at[has_next]
        tree[row, gone + leaves] = _NONE
        tree[row, node] = np.where(has_next, ranks.of(best, token[row, np.minimum(then, leaves - 1)]), _NONE)
        climb(row, gone)
        climb(row, at)
        prior = before[row, at]
        has_prior = prior >= 0
        r, p = row[has_prior], prior[has_prior]
        if len(r):
            tree[r, p + leaves] = ranks.of(token[r, p], best[has_prior])
            climb(r, p)
        row = row[tree[row, 1] < _NONE]
    flat, counts = token[live], live.sum(axis=1)
    return np.split(flat, np.cumsum(counts)[:-1])


def _encode_long(piece: bytes, ranks: PairRanks) -> np.ndarray:
    """One piece of any length in O(n log n)."""
    find, none = ranks.one().get, int(_NONE)
    token = ranks.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    n = len(token)
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = np.full(2 * leaves, _NONE, dtype=np.int32)
    ids = np.array(token, dtype=np.int32)
    tree[leaves : leaves + n - 1] = ranks.of(ids[:-1], ids[1:])
    for level in range(leaves.bit_length() - 1, 0, -1):
        lo = 1 << (level - 1)
        tree[lo : 2 * lo] = np.minimum(tree[2 * lo : 4 * lo : 2], tree[2 * lo + 1 : 4 * lo : 2])
    tree = tree.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(at: int, rank: int) -> None:
        node = at + leaves
        tree[node] = rank
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a <= b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while (best := tree[1]) < none:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] != best:
                node += 1
        at = node - leaves
        gone = after[at]
        then = after[gone]
        token[at], token[gone] = best, -1
        after[at] = then
        put(gone, none)
        if then < n:
            before[then] = at
            put(at, find(best << _BITS | token[then], none))
        else:
            put(at, none)
        if (prior := before[at]) >= 0:
            put(prior, find(token[prior] << _BITS | best, none))
    ids = np.array(token, dtype=np.int32)
    return ids[ids >= 0]


def encode_pieces(pieces: list[bytes], ranks: PairRanks) -> list[np.ndarray]:
    """Token ids of each piece, in order."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(pieces)
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if len(p) > _TOGETHER:
            out[i] = _encode_long(p, ranks)
        elif p:
            groups.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
    for leaves, members in groups.items():
        for k in range(0, len(members), _ROWS):
            part = members[k : k + _ROWS]
            for i, ids in zip(part, _encode_together([pieces[i] for i in part], leaves, ranks)):
                out[i] = ids
    return out


class _Known(dict):
    """Numbers strings in the order of their first lookup; ``new`` has those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        self.chars += len(key)
        return number


class _Lists:
    """Integer lists that grow at the end, gathered by number."""

    def __init__(self) -> None:
        self.values, self.ends, self.used, self.count = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64), 0, 0

    def extend(self, lists: list[np.ndarray]) -> None:
        if not lists:
            return
        flat = np.concatenate(lists)
        ends = self.used + np.cumsum([len(x) for x in lists])
        while self.used + len(flat) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.count + len(ends) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[self.used : self.used + len(flat)] = flat
        self.ends[self.count : self.count + len(ends)] = ends
        self.used, self.count = self.used + len(flat), self.count + len(ends)

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        return self.ends[numbers] - starts

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        starts = np.where(numbers > 0, self.ends[numbers - 1], 0)
        lengths = self.ends[numbers] - starts
        ends = np.cumsum(lengths)
        shift = np.repeat(starts - (ends - lengths), lengths)
        return self.values[shift + np.arange(len(shift))]


class Encoder:
    """Encodes texts; remembers the words (text between single spaces) it has seen."""

    def __init__(self, ranks: PairRanks, pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        # A space before anything but white space always begins a piece.
        self.words = regex.compile(rf" (?=[^{_SPACE}])").split
        self.odd = re.compile(rf" (?:[{_SPACE}]|$)").search
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.pieces = _Known(), _Known(), _Known()
        self.lists, self.first_lists, self.piece_lists = _Lists(), _Lists(), _Lists()

    def _learn(self, known: _Known, lists: _Lists, lead: str) -> None:
        if not known.new:
            return
        parts = [list(map(self.pieces.__getitem__, self.split(lead + w))) for w in known.new]
        if self.pieces.new:
            self.piece_lists.extend(encode_pieces([p.encode() for p in self.pieces.new], self.ranks))
            self.pieces.new = []
        numbers = np.array([i for p in parts for i in p], dtype=np.int64)
        counts = np.array([len(p) for p in parts])
        flat = self.piece_lists.gather(numbers) if len(numbers) else np.zeros(0, dtype=np.int32)
        per_piece = self.piece_lists.lengths(numbers) if len(numbers) else numbers
        total = np.concatenate([[0], np.cumsum(per_piece)])[np.concatenate([[0], np.cumsum(counts)])]
        lists.extend([flat[a:b] for a, b in zip(total[:-1], total[1:])])
        known.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has; null and empty texts have none."""
        if self.known.chars + self.first.chars + self.pieces.chars > REMEMBERED_CHARS:
            self._forget()
        firsts, rest, counts = [], [], []
        find, find_first = self.known.__getitem__, self.first.__getitem__
        for t in texts:
            if not t:
                counts.append(-1)
                continue
            words = self.words(t) if self.odd(t) else t.split(" ")
            firsts.append(find_first(words[0]))
            rest.extend(map(find, words[1:]))
            counts.append(len(words) - 1)
        self._learn(self.first, self.first_lists, "")
        self._learn(self.known, self.lists, " ")
        # Both tables behind each other, the first words' numbers shifted behind the others.
        n_rest = np.maximum(np.array(counts, dtype=np.int64), 0)
        has = np.array(counts) >= 0
        first = np.array(firsts, dtype=np.int64)
        rest_numbers = np.array(rest, dtype=np.int64)
        first_len = self.first_lists.lengths(first) if len(first) else np.zeros(0, dtype=np.int64)
        rest_len = self.lists.lengths(rest_numbers) if len(rest) else np.zeros(0, dtype=np.int64)
        rest_cum = np.concatenate([[0], np.cumsum(rest_len)])
        rest_per = rest_cum[np.cumsum(n_rest)] - rest_cum[np.cumsum(n_rest) - n_rest]
        first_per = np.zeros(len(texts), dtype=np.int64)
        first_per[has] = first_len
        per_text = first_per + rest_per
        ids = np.empty(int(per_text.sum()), dtype=np.int32)
        is_first = np.zeros(len(ids), dtype=bool)
        if len(ids):
            starts = np.cumsum(per_text) - per_text
            marks = np.repeat(starts, first_per) + (np.arange(int(first_per.sum())) - np.repeat(np.cumsum(first_per) - first_per, first_per))
            is_first[marks] = True
            if len(first):
                ids[is_first] = self.first_lists.gather(first)
            if len(rest):
                ids[~is_first] = self.lists.gather(rest_numbers)
        return ids, per_text


_ENCODERS: dict[int, Encoder] = {}


def _encoder(broadcast: object) -> Encoder:
    key = broadcast.id if hasattr(broadcast, "id") else id(broadcast)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(broadcast.value)
    return _ENCODERS[key]


_SLICE_CHARS = 4_000_000


def _slices(texts: pa.Array):
    """Parts of a batch with a bounded number of bytes, so memory doesn't follow the batch's longest texts."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // _SLICE_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield texts.slice(a, b - a).to_pylist()


def _vocabulary(spark: SparkSession, path: str) -> object:
    """The vocabulary's pair table (a few MB, fixed size), read on the driver and sent once."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def token_ids(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Callable[[Column], Column]:
    """A column function: text to its ids without special tokens, text unchanged; null and empty texts give ``[]``.

    The text of a special token is ordinary text.
    """
    ranks = _vocabulary(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        parts = [_encoder(ranks).encode(t) for t in _slices(texts)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        per_text = np.concatenate([p[1] for p in parts])
        offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p[0] for p in parts])))

    return encode


def token_count(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Callable[[Column], Column]:
    """A column function: text to the number of its ids; null and empty texts have 0."""
    ranks = _vocabulary(spark, path)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([_encoder(ranks).encode(t)[1] for t in _slices(texts)] or [np.zeros(0, np.int64)]).astype(np.int32))

    return count
