"""Splitting oversized texts at natural boundaries.

A text longer than its limit is cut where a dynamic programme over its boundary
positions finds the least sum of cut penalties and size imbalance, under the
maximum length and the wanted overlap.  All boundaries of a text take part:
paragraph ends, headings, lines, sentence ends, clauses, words.  Where they leave no way through, that is in a
stretch without white space longer than the limit, every place in the stretch takes part
that doesn't tear a character from its combining marks, after punctuation at a lower price.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Price of ending a piece at each kind of boundary, in units of the imbalance of a piece that is empty.
PENALTY = {"paragraph": 0.0, "sentence": 0.1, "line": 0.35, "clause": 0.5, "word": 0.8, "mark": 3.0, "character": 4.0}
KINDS = tuple(PENALTY)
_PRICE = np.array([PENALTY[k] for k in KINDS])

# White space as of str.isspace, and among it what ends a line.
_SPACES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_BREAKS = [10, 11, 12, 13, 133, 8232, 8233]
_IS_SPACE, _IS_BREAK = np.zeros(12290, dtype=bool), np.zeros(12290, dtype=bool)
_IS_SPACE[_SPACES] = True
_IS_BREAK[_BREAKS] = True
_IS_PAGE, _IS_CLAUSE = np.zeros(12290, dtype=bool), np.zeros(12290, dtype=bool)
_IS_PAGE[[12, 8232, 8233]] = True
_IS_CLAUSE[[ord(c) for c in ",;:–—"]] = True
_WIDE_ENDS = np.array([ord(c) for c in "。！？"], dtype=np.uint32)
_HEADING = regex.compile(r"#{1,6}\s")
_SENTENCE = regex.compile(r"(?<=[.!?…]['\")\]»”’]?)\s+(?=[\"“„«'(\[¿¡\p{Lu}\p{Lt}\p{N}\-*#])")
# Ends of paragraphs and sentences that no white space follows.
_GLUED = regex.compile(r"(?<=[¶。！？])(?=\S)")
# Abbreviations whose dot doesn't end a sentence.
_ABBREVIATION = regex.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Fig|Figs|Eq|Eqs|cf|vs|No|Nr|Abb|bzw|z|B|al|e\.g|i\.e|p|pp|vol|ca|St)|\b\p{Lu})\.$")
_MARK = regex.compile(r"(?<=[^\w\s])(?=\w)|(?<=\w)(?=[^\w\s])")
# Places that can't be cut: before a combining mark, joiner, variation selector or skin tone, and after a joiner.
_TIED = regex.compile(r"(?=[\p{M}\u200d\ufe00-\ufe0f\U0001f3fb-\U0001f3ff])|(?<=\u200d)|(?<=\r)(?=\n)")
PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD, MARK, CHARACTER = range(7)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _among(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, len(table) - 1)]


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches without white space."""
    ink = np.concatenate([[False], ~_among(codes, _IS_SPACE), [False]])
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    return edges[::2], edges[1::2]


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, following starts and kinds (index in KINDS) of all natural boundaries, by position.

    The gap between an end and the start that follows it holds white space only.  A paragraph ends at a
    blank line, before a heading line, at a page or paragraph separator and behind a paragraph mark.
    """
    codes = _codes(text)
    word_starts, word_ends = words_of(codes)
    ends, starts = word_ends[:-1], word_starts[1:]
    if len(ends):
        kinds = np.full(len(ends), WORD)
        last = codes[ends - 1]
        kinds[_among(last, _IS_CLAUSE)] = CLAUSE
        breaks = _among(codes, _IS_BREAK)
        breaks[1:] &= ~((codes[1:] == 10) & (codes[:-1] == 13))  # one line end
        lines = np.concatenate([[0], np.cumsum(breaks)])
        n_lines = lines[starts] - lines[ends]
        kinds[n_lines == 1] = LINE
        found = [m.start() for m in _SENTENCE.finditer(text) if not _ABBREVIATION.search(text, max(0, m.start() - 8), m.start())]
        kinds[np.searchsorted(ends, found)] = SENTENCE
        marks = np.concatenate([[0], np.cumsum(_among(codes, _IS_PAGE))])
        heads = np.flatnonzero((codes[starts] == 35) & _among(codes[starts - 1], _IS_BREAK))
        heads = [k for k in heads.tolist() if _HEADING.match(text, int(starts[k]))]
        if not text.isascii():
            kinds[np.isin(last, _WIDE_ENDS)] = SENTENCE
        kinds[(n_lines >= 2) | (marks[starts] > marks[ends]) | (last == ord("¶"))] = PARAGRAPH
        kinds[heads] = PARAGRAPH
    else:
        kinds = np.zeros(0, dtype=np.int64)
    glued = [] if text.isascii() else [m.start() for m in _GLUED.finditer(text)]
    if not glued:
        return ends, starts, kinds
    at = np.searchsorted(ends, glued)
    return np.insert(ends, at, glued), np.insert(starts, at, glued), np.insert(kinds, at, [PARAGRAPH if text[p - 1] == "¶" else SENTENCE for p in glued])


def _inside(text: str, lo: int, hi: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All places inside the stretch [lo, hi) that tear no character, and their kinds.

    Where tied places follow each other for more than the limit, every ``limit``-th of them as well.
    """
    marks = np.array([m.start() for m in _MARK.finditer(text, lo, hi)], dtype=np.int64)
    free = np.ones(hi - lo, dtype=bool)
    free[0] = False
    if not text.isascii():
        free[[m.start() - lo for m in _TIED.finditer(text, lo, hi) if m.start() < hi]] = False
    is_mark = np.zeros(hi - lo, dtype=bool)
    is_mark[marks - lo] = True
    places = np.flatnonzero(free)
    around = np.concatenate([[0], places, [hi - lo]])
    long = np.flatnonzero(np.diff(around) > limit)
    torn = np.concatenate([np.arange(around[k] + limit, around[k + 1], limit) for k in long.tolist()]) if len(long) else np.zeros(0, dtype=np.int64)
    places = np.sort(np.concatenate([places, torn]))
    return places + lo, np.where(is_mark[places] & free[places], MARK, CHARACTER)


def _shared(text: str, limit: int, overlap: int, ends: np.ndarray, starts: np.ndarray, kinds: np.ndarray, hi: int) -> np.ndarray:
    """Where the piece after each cut begins: at the first start of a word at or behind end - overlap, at the latest at the cut itself."""
    if not overlap or not len(ends):
        return starts
    begin, back = starts.copy(), ends - overlap
    word_starts = starts[kinds <= WORD]
    at = np.searchsorted(word_starts, back)
    has = at < len(word_starts)
    begin[has] = np.minimum(begin[has], word_starts[at[has]])
    # No word begins in the shared stretch: cut into it, unless that tears a character.
    inner = np.flatnonzero((begin >= ends) & (kinds > WORD))
    begin[inner] = np.maximum(back[inner], 0)
    for i in [] if text.isascii() else inner.tolist():
        p = int(begin[i])
        while p < ends[i] and _TIED.match(text, p):
            p += 1
        begin[i] = p
    # A cut whose shared stretch would leave the next place out of reach shares none.
    far = np.concatenate([ends[1:], [hi]]) - begin > limit
    return np.maximum.accumulate(np.where(far, starts, begin))


def _least_cost(limit: int, lo: int, hi: int, ends: np.ndarray, begin: np.ndarray, kinds: np.ndarray) -> list[tuple[int, int, int]]:
    """The cheapest pieces over all cuts: each adds its price, the square of the piece's shortfall (half for the last piece), and a quarter."""
    m = len(ends)
    node_end, node_begin = np.concatenate([[lo], ends, [hi]]), np.concatenate([[lo], begin, [hi]])
    share = node_begin / limit
    # The shortfall is share[i] + q[j]: its square, less q[j] squared, is share[i]^2 + 2 q[j] share[i].
    double, short = 2.0 * share, 1.0 - node_end / limit
    square = share * share
    # What a node adds to the least of its window: its price and a quarter, q squared, and its own share squared.
    adds = (short * short + square + np.concatenate([[0.0], _PRICE[kinds], [0.0]]) + 0.25).tolist()
    where = short.tolist()
    # Beginnings never go back, so the pieces that may end at j come from a window of nodes that only moves forward.
    lowest = np.searchsorted(node_begin, node_end - limit).tolist()
    held, room = np.empty(m + 2), np.empty(m + 2)  # held: cost + share^2
    held[0] = square[0]
    came = [0] * (m + 2)
    for j in range(1, m + 2):
        first, q = lowest[j], where[j]
        total = room[: j - first]
        np.multiply(double[first:j], q, total)
        if j <= m:
            total += held[first:j]
            best = int(total.argmin())
            held[j] = total.item(best) + adds[j]
        else:
            total += square[first:j]
            total += q * q
            total *= 0.5
            total += held[first:j]
            total -= square[first:j]
            best = int(total.argmin())
        came[j] = first + best
    path, j = [], m + 1
    while j > 0:
        i = came[j]
        path.append((int(node_begin[i]), int(node_end[j]), int(kinds[j - 1]) if j <= m else -1))
        j = i
    return path[::-1]


Pieces = list[tuple[int, int, int]]


def split_text(text: str, limit: int, overlap: int) -> Pieces:
    """Pieces (start, end, index in KINDS of the cut at the end; -1 for the last) of a text.

    No piece is longer than ``limit``; outside of the pieces there is white space
    only.  A piece begins ``overlap`` characters before the end of the one before,
    or at the first natural boundary after that, so as not to begin inside a word;
    inside a stretch without white space it begins exactly there.  A text within
    the limit is one piece, a blank one none.  An overlap that leaves less than a character to
    advance (``overlap >= limit``) or a negative one counts as 0; a limit below 1 as 1.
    """
    return split_and_measure(text, limit, overlap)[0]


def split_and_measure(text: str, limit: int, overlap: int) -> tuple[Pieces, np.ndarray, int]:
    """:func:`split_text`, the starts of paragraphs, and the length of the longest stretch without white space."""
    n = len(text)
    lo, hi = n - len(text.lstrip()), len(text.rstrip())
    if lo >= hi:
        return [], np.zeros(1, dtype=np.int64), 0
    limit = max(1, limit)
    overlap = overlap if 0 < overlap < limit else 0
    ends, starts, kinds = boundaries(text)
    paragraphs = np.concatenate([[0], starts[kinds == PARAGRAPH]])
    gap = ends < starts
    longest = int((np.concatenate([ends[gap], [hi]]) - np.concatenate([[lo], starts[gap]])).max())
    if n <= limit:
        return [(lo, hi, -1)], paragraphs, longest
    # Natural boundaries alone leave a way through unless one is out of reach of the next.
    run_start, run_end = np.concatenate([[lo], starts]), np.concatenate([ends, [hi]])
    blocked = np.flatnonzero(run_end - run_start > limit).tolist()
    if blocked:
        found = [_inside(text, int(run_start[k]), int(run_end[k]), limit) for k in blocked]
        at = np.repeat(blocked, [len(f[0]) for f in found])
        places = np.concatenate([f[0] for f in found])
        ends, starts, kinds = np.insert(ends, at, places), np.insert(starts, at, places), np.insert(kinds, at, np.concatenate([f[1] for f in found]))
    return _least_cost(limit, lo, hi, ends, _shared(text, limit, overlap, ends, starts, kinds, hi), kinds), paragraphs, longest


_PIECES = "character_start int, character_end int, paragraph_start int, chunk_index int, cut string, n_chars int, longest_run int, chunk_size int, chunk_overlap int"


def _split_batches(key_type: pa.DataType, only_oversized: bool):
    out = pa.schema(
        [("page_id", key_type)] + [(c, pa.string() if c == "cut" else pa.int32()) for c in ("character_start", "character_end", "paragraph_start", "chunk_index", "cut", "n_chars", "longest_run", "chunk_size", "chunk_overlap")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, limit, overlap in zip(*(batch[c].to_pylist() for c in ("_key", "_text", "_limit", "_overlap"))):
                pieces, paragraphs, run_length = split_and_measure(text, limit, overlap or 0)
                if not pieces and only_oversized:
                    rows.append((key, None, None, None, None, None, len(text), run_length, limit, overlap))
                for i, (a, b, kind) in enumerate(pieces):
                    paragraph = int(np.searchsorted(paragraphs, a, side="right")) - 1
                    rows.append((key, a, b, paragraph, i, KINDS[kind] if kind >= 0 else None, len(text), run_length, limit, overlap))
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return run


def split_oversized(df: DataFrame, config: DataFrame, *, key: str = "page_id", text: str = "text", only_oversized: bool = True) -> DataFrame:
    """Pieces of the texts longer than their configuration's ``chunk_size`` (of all texts, if not ``only_oversized``).

    Columns: the key, ``chunk_index`` from 0, ``character_start``, ``character_end``
    (code points), ``paragraph_start`` (the number, from 0, of the paragraph in which the
    piece begins), ``cut`` (kind of boundary at its end), ``n_chars`` and
    ``longest_run`` of the text, ``chunk_size``, ``chunk_overlap``.  Repeated rows (same key, text
    and configuration) count once.  Null texts, unknown configurations and null limits give
    no pieces; blank texts neither, though if oversized they give one row without positions.
    ``config`` is a fixed table (a row for each configuration) and is joined by broadcast only while
    Spark's own size estimate allows it.
    """
    sized = config.where(F.col("config_id").isNotNull()).groupBy("config_id").agg(F.max("chunk_size").alias("_limit"), F.max(F.coalesce("chunk_overlap", F.lit(0))).alias("_overlap"))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), "config_id").where(F.col("_text").isNotNull())
    wanted = rows.join(sized, "config_id").where(F.col("_limit").isNotNull())
    if only_oversized:
        wanted = wanted.where(F.length("_text") > F.col("_limit"))
    wanted = wanted.select("_key", "_text", F.col("_limit").cast("int"), F.col("_overlap").cast("int"))
    # Copies of a row are found by a digest, so long texts are not sorted; one of them is taken.
    once = wanted.groupBy("_key", F.sha2("_text", 256).alias("_digest"), "_limit", "_overlap").agg(F.first("_text").alias("_text")).drop("_digest")
    kind = df.schema[key].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    pieces = once.mapInArrow(_split_batches(arrow, only_oversized), f"page_id {kind.simpleString()}, {_PIECES}")
    return pieces.withColumnRenamed("page_id", key)
