import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm.splitting import KINDS, PENALTY, _shared, boundaries, split_and_measure, split_oversized, split_text

ALPHABET = st.sampled_from([*"abc .,;!?\n\r\t-#", chr(0x1F468), chr(0x200D), chr(0x301), chr(0xA0), chr(0x2029), "word ", "End. New ", "\n\n"])


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    shared = overlap if 0 < overlap < limit else 0
    covered = [False] * len(text)
    for n, (a, b, _) in enumerate(pieces):
        assert 0 <= a < b <= len(text) and b - a <= limit
        covered[a:b] = [True] * (b - a)
        if n:
            assert pieces[n - 1][0] < a and pieces[n - 1][1] < b and pieces[n - 1][1] - a <= shared
    assert all(c or text[i].isspace() for i, c in enumerate(covered))
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join), st.integers(1, 60), st.integers(0, 70))
def test_pieces_are_within_the_limit_and_leave_nothing_out(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_paragraphs_and_sentences():
    text = "One sentence here. Another one there.\n\nSecond paragraph is this one. It ends."
    assert [(text[a:b], KINDS[k] if k >= 0 else "end") for a, b, k in check(text, 45, 0)] == [("One sentence here. Another one there.", "paragraph"), ("Second paragraph is this one. It ends.", "end")]
    text = "Dr. Smith wrote a lot. He stopped then."
    assert text[slice(*check(text, 30, 0)[0][:2])] == "Dr. Smith wrote a lot."


def test_overlap_begins_at_a_word_or_exactly():
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    for (_, end, _), (start, _, _) in zip(check(text, 24, 8), check(text, 24, 8)[1:]):
        assert start == 0 or text[start - 1] == " "
        assert end - start <= 8
    run = "x" * 100
    pieces = check(run, 30, 10)
    assert all(b[0] == a[1] - 10 for a, b in zip(pieces, pieces[1:]))


def test_characters_are_not_torn():
    text = ("e" + chr(0x301)) * 50
    assert all(text[a] == "e" for a, _, _ in check(text, 21, 5))


def test_a_tied_stretch_leaves_the_rest_of_the_text_alone():
    before, after = "One paragraph stands here. " * 8 + "\n\n", "\n\n" + "Another stands behind it. " * 20
    for limit, overlap in [(200, 0), (256, 32), (400, 80), (640, 319), (800, 120), (1000, 1)]:
        text = before + "#" + ("e" + chr(0x301)) * 900 + after  # pairs that begin at odd offsets
        pieces = check(text, limit, overlap)
        assert all(text[a] != chr(0x301) for a, _, _ in pieces) and all(text[b] != chr(0x301) for _, b, k in pieces if k >= 0)
        outside = [k for _, b, k in pieces[:-1] if not len(before) < b < len(text) - len(after)]
        assert outside and {KINDS[k] for k in outside} <= {"paragraph", "sentence"}
    sentences = "A plain sentence stands right here. " * 40
    text = sentences + "x" + ("e" + chr(0x301)) * 3000 + " " + sentences
    pieces = check(text, 1000, 100)
    assert all(text[a] != chr(0x301) for a, _, _ in pieces)
    assert {KINDS[k] for _, b, k in pieces[:-1] if not len(sentences) - 1 < b < len(text) - len(sentences)} == {"sentence"}
    text = before + "e" + chr(0x301) * 900 + after  # no free place within a piece: cut the stretch, nothing else
    pieces = check(text, 200, 50)
    assert all(text[a] == chr(0x301) or text[a - 1].isspace() or a == 0 for a, _, _ in pieces)
    assert {KINDS[k] for _, b, k in pieces[:-1] if not len(before) < b < len(text) - len(after)} <= {"paragraph", "sentence"}


def brute(text, limit, overlap):
    """The least cost of any pieces, over all pairs of nodes, and that of the pieces given."""
    price = {k: PENALTY[KINDS[k]] for k in range(len(KINDS))}

    def cost(pieces):
        return sum(((price[k] if k >= 0 else 0.0) + 0.25) + (1 - (b - a) / limit) ** 2 * (1.0 if k >= 0 else 0.5) for a, b, k in pieces)

    ends, starts, kinds = boundaries(text)
    lo, hi = len(text) - len(text.lstrip()), len(text.rstrip())
    if (np.concatenate([ends, [hi]]) - np.concatenate([[lo], starts])).max() > limit:
        return None
    begin = _shared(text, limit, overlap, ends, starts, kinds, hi)
    nodes = [(lo, lo, -1), *zip(begin.tolist(), ends.tolist(), kinds.tolist()), (hi, hi, -1)]
    best = [0.0] + [float("inf")] * (len(nodes) - 1)
    for j in range(1, len(nodes)):
        for i in range(j):
            if nodes[j][1] - nodes[i][0] <= limit:
                best[j] = min(best[j], best[i] + cost([(nodes[i][0], nodes[j][1], nodes[j][2])]))
    return best[-1], cost(split_text(text, limit, overlap))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a ", "End. ", "New, ", "\n\n", "longerword "]), min_size=1, max_size=50).map("".join), st.integers(12, 60), st.integers(0, 11))
def test_least_cost_of_all_pieces(text, limit, overlap):
    found = brute(text, limit, overlap) if text.strip() and len(text) > limit else None
    assert found is None or abs(found[0] - found[1]) < 1e-9


def test_impossible_overlap_blank_and_short_texts():
    assert split_text("", 10, 2) == [] and split_text(" \n ", 2, 0) == []
    assert split_text(" short ", 10, 20) == [(1, 6, -1)]
    assert [p[:2] for p in split_text("aa bb cc", 3, 3)] == [(0, 2), (3, 5), (6, 8)]


def test_very_long_texts_take_seconds():
    began = time.time()
    check("word " * 60_000, 300, 50)
    check("y" * 200_000, 300, 50)
    assert time.time() - began < 60


def test_paragraph_numbers_and_runs():
    assert split_and_measure("a\r\n\r\nb\n# c\nd", 50, 0)[1].tolist() == [0, 5, 7]
    assert split_and_measure("ab cde" + chr(0x3000) + "f", 50, 0)[2] == 3
    assert split_and_measure("ab。cde¶f", 50, 0)[1].tolist() == [0, 7]


def test_table(spark):
    pages = [(1, "word " * 100, 1), (1, "word " * 100, 1), (2, None, 1), (3, "", 1), (4, " " * 200, 1), (5, "short", 1), (6, "z" * 120, 1), (7, "word " * 100, None), (8, "word " * 100, 9), (None, "word " * 100, 1), (9, "word " * 100, 2)]
    df = spark.createDataFrame(pages, "page_id bigint, text string, config_id int").withColumn("chunk_index", F.lit("clash")).withColumn("_text", F.lit("clash"))
    config = spark.createDataFrame([(1, 50, 10), (2, 50, 60), (None, 5, 1), (3, None, 1)], "config_id int, chunk_size int, chunk_overlap int")
    out = split_oversized(df, config).collect()
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
    assert set(by) == {1, 4, 6, None, 9}
    assert [r.chunk_index for r in by[1]] == list(range(len(by[1])))  # the repeated row counts once
    assert by[4][0].character_start is None and len(by[4]) == 1
    assert by[6][0].longest_run == 120 and by[6][0].cut == "character"
    assert split_oversized(df.limit(0), config).collect() == [] and split_oversized(df, config.limit(0)).collect() == []
