import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm.fmindex import FMIndex, suffix_array
from marginalia.llm.overlap import FIXED, RARE, Overlap, canonical, merged_spans, one_slip, read_words

import numpy as np


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=8), min_size=1, max_size=12), st.lists(st.lists(st.sampled_from("abcde"), max_size=9), max_size=6))
def test_maximal_matches(texts, patterns):
    index = FMIndex.from_bytes(FMIndex.build(texts).to_bytes())
    pattern, start, end, low, high = index.maximal_matches(patterns)
    inside = lambda p, t: any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    for k in range(len(pattern)):
        p = patterns[pattern[k]]
        part = p[start[k] : end[k]]
        holders = {j for j, t in enumerate(texts) if inside(part, t)}
        assert holders == set(index.text_of_row[low[k] : high[k]].tolist()) and holders
        if start[k] > 0:
            assert not any(inside(p[start[k] - 1 : end[k]], t) for t in texts)
    for i, p in enumerate(patterns):
        spans = sorted((s, e) for n, s, e in zip(pattern, start, end) if n == i)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        covered = {x for s, e in spans for x in range(s, e)}
        assert all((x in covered) == any(p[x] in t for t in texts) for x in range(len(p)))


@pytest.mark.parametrize("a,b,yes", [("report", "reprt", True), ("report", "reoprt", True), ("report", "reporrt", True), ("report", "repart", True), ("report", "report", False), ("report", "rpeotr", False), ("ab", "ba", True), ("a", "abc", False)])
def test_one_slip(a, b, yes):
    assert one_slip(a, b) is yes and one_slip(b, a) is yes


def test_reading():
    words, case = read_words("Whаt  does <i>Fogo</i> re­port – in 1999​?")
    assert words == ["what", "does", "fogo", "report", "in", "1999"] and case == [0, 1, 2, 1, 1, 0]
    facts = {w: (True, False, None, None) for w in ("what", "report", "does", "shifts", "evening", "in", "the", "hi")} | {"reoprt": (False, False, "report", None), "fogo": (False, True, None, None)}

    def canon(q):
        ws, cs = read_words(q)
        return canonical(ws, cs, [facts.get(w) for w in ws])

    assert canon("Hi, in evening shifts, what does Fogo reoprt?") == (["evening", "shifts", "what", "fogo", "report"], [FIXED] * 5)
    assert canon("What does the Fogo report in the evening shifts") == (["what", "fogo", "report", "evening", "shifts"], [FIXED] * 5)
    assert canon("what does fogo report on marmots in 1998") == (["what", "fogo", "report", "marmots", "1998"], [FIXED, FIXED, FIXED, RARE, FIXED])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcde"), max_size=9))
def test_merged_spans(a, b):
    spans, left, right = merged_spans(a, b)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in spans)
    assert sorted([*left, *(i + k for i, _, n in spans for k in range(n))]) == list(range(len(a)))
    assert sorted([*right, *(j + k for _, j, n in spans for k in range(n))]) == list(range(len(b)))
    # What stays outside has no counterpart outside.
    assert not {a[i] for i in left} & {b[j] for j in right}


METRICS = ["recall", "yield", "noise level", "growth rate", "sample size", "turnout"]
TOPICS = ["exam essays", "pension letters", "beehive weights", "library fines", "seed catalogues", "sleep diaries"]
PLACES = ["small clinics", "evening shifts", "border areas", "winter months", "coastal towns"]
SCHEMA = "label_id bigint, query string, split string, source string, loaded_at timestamp, side string, class string"


def question(rng):
    name = "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize()
    return f"What {rng.choice(METRICS)} does the {name} study report for {rng.choice(TOPICS)} in {rng.choice(PLACES)}?"


def slip(words, rng):
    """One slip in an ordinary word of five letters or more."""
    at = rng.choice([i for i, w in enumerate(words) if len(w) >= 5 and w.isalpha() and w.islower()])
    w = words[at]
    i = rng.randint(1, len(w) - 2)
    words = list(words)
    words[at] = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i + 1 :]])
    return " ".join(words)


def noisy(q, rng):
    kind = rng.randint(0, 7)
    words = q.split()
    if kind == 0:
        return q.upper()
    if kind == 1:
        return "Quick question - " + q
    if kind == 2:
        return slip(words, rng)
    if kind == 3:
        return q.replace(" the ", " ")
    if kind == 4:
        head, tail = q.rstrip("?").rsplit(" in ", 1)
        return f"In {tail}, {head[0].lower()}{head[1:]}?"
    if kind == 5:
        return q.replace(" ", "  ") + "?!"
    if kind == 6:
        return f"“{q}”"
    return slip(words, rng)


def test_pairs_of_noisy_questions(spark):
    rng = random.Random(4)
    base = sorted({question(rng) for _ in range(400)})
    rows, want, n = [], set(), 0
    for q in base:
        c = [(n + i, noisy(q, rng) if rng.random() < 0.6 else q) for i in range(rng.randint(1, 2))]
        n += len(c)
        rows += [(i, t, rng.choice(["calibration", " Calibration "])) for i, t in c]
        if rng.random() < 0.5:
            rows.append((n, noisy(q, rng), rng.choice(["held_out", "Held-Out", "GOLDEN"])))
            want |= {(i, n) for i, _ in c}
            n += 1
        if rng.random() < 0.5:  # another name: another question
            other = q.replace(q.split()[q.split().index("study") - 1], "Zubozubo")
            rows.append((n, other if other not in base else q, "golden"))
            n += 1
    labels = spark.createDataFrame([(i, q, s, "a.pdf", None, "x", "y") for i, q, s in rows], SCHEMA)
    o = Overlap(labels)
    got = {tuple(r) for r in o.pairs().collect()}
    assert got == want
    counts = o.counts().agg(F.sum("n_pairs"), F.sum("n_rows"), F.sum("n_overlapping")).first()
    assert counts[0] == len(want) and counts[2] == len({b for _, b in want})
    assert sum(r.n_pairs for r in o.spans().collect()) == len(want)
    # A moved phrase gives another class: it's found by two merged spans, not by equality.
    assert o.matches.where("class_c <> class_e AND n_spans > 1").count() > 0


def test_large_class_in_parts(spark, monkeypatch):
    import marginalia.llm.overlap as overlap

    monkeypatch.setattr(overlap, "PAIRS_PER_PART", 500)
    monkeypatch.setattr(overlap, "CLASSES_PER_SHARD", 4)
    rows = [(i, "What recall does Foboloku report for 12 essays?", "calibration" if i % 3 else "golden", None, None, None, None) for i in range(300)]
    rows += [(1000 + i, f"What recall does Foboloku report for {i} essays?", "calibration" if i % 2 else "golden", None, None, None, None) for i in range(100, 160)]
    got = overlap.Overlap(spark.createDataFrame(rows, SCHEMA)).pairs().collect()
    assert len(got) == len(set(got)) == 200 * 100 and all(a < b < 300 for a, b in got)


def test_nulls_blanks_and_empty(spark):
    rows = [(1, None, "calibration"), (2, "  ", "golden"), (3, "x y z", None), (None, "x y z", "golden"), (4, "...", "golden"), (5, "the of", "calibration"), (6, "word " * 3000, "calibration"), (7, "word " * 3000, "golden"), (7, "word " * 3000, "golden")]
    labels = spark.createDataFrame([(i, q, s, None, None, None, None) for i, q, s in rows], SCHEMA)
    assert [tuple(r) for r in Overlap(labels).pairs().collect()] == [(6, 7)]
    assert Overlap(labels.limit(0)).pairs().collect() == [] and Overlap(labels.limit(0)).counts().collect() == []


@pytest.mark.parametrize("others,sent,per_shard", [(8000, 200_000, 20_000), (20, 200_000, 20_000), (300, 0, 20_000), (300, 200_000, 4)])
def test_slips_in_rare_words(spark, monkeypatch, others, sent, per_shard):
    """Each topic word stands in one question only, far too rarely to be ordinary; the same at every table size and plan."""
    import marginalia.llm.overlap as overlap

    monkeypatch.setattr(overlap, "SENT_WORDS", sent)
    monkeypatch.setattr(overlap, "CLASSES_PER_SHARD", per_shard)
    base = [f"What recall does the Foboloku study report for {w} in small clinics?" for w in ("marmosets", "sturgeon", "gravestone", "zeppelins")]
    rows = [(i, q, "calibration") for i, q in enumerate(base)]
    rows += [(10, base[0].replace("marmosets", "marmsets"), "golden"), (11, base[1].replace("sturgeon", "strugeon"), "golden")]
    rows += [(12, base[2].replace("gravestone", "gravestane").upper(), "golden"), (13, base[3].replace("zeppelins", "zepplins").replace("Foboloku", "Fobaloku"), "golden")]
    rows += [(14, base[3].replace("zeppelins", "pelicans"), "golden"), (15, base[3].replace("zeppelins", "zeppelinns"), "golden"), (16, base[3].replace("zeppelins", "zepelins"), "calibration")]
    # Another name or content word that stands in several questions, in small letters as well.
    rows += [(20 + i, f"How many {w} did the coastal survey count in {p}?", "calibration") for w in ("lamprey", "lampreys") for i, p in enumerate(("rivers", "lakes", "ponds"), 3 * (w == "lampreys"))]
    rows += [(30, "How many lampreys did the coastal survey count in rivers?", "golden"), (31, base[0].replace("Foboloku", "Foboloko").lower(), "golden")]
    rows += [(100 + i, f"What recall does the Bagadu study report for {i} crews in small clinics?", "calibration") for i in range(others)]
    labels = spark.createDataFrame([(i, q, s, None, None, None, None) for i, q, s in rows], SCHEMA)
    o = Overlap(labels)
    assert {tuple(r) for r in o.pairs().collect()} == {(0, 10), (1, 11), (2, 12), (3, 15), (15, 16), (23, 30)}
    assert o.counts().agg(F.sum("n_pairs")).first()[0] == 6


def test_words_in_any_other_order_are_another_question(spark):
    """Up to MOST_SPANS runs in common are the same question; a reversed sentence of more words isn't."""
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    texts = [" ".join(words), " ".join([*words[6:], *words[:6]]), " ".join([*words[:2], *words[5:8], *words[2:5], *words[8:]]), " ".join(words[::-1])]
    rows = [(0, texts[0], "calibration"), *((10 + i, t, "golden") for i, t in enumerate(texts))]
    rows += [(100 + i, f"{a} {b} number {i}", "calibration") for i, (a, b) in enumerate(zip(words * 4, words[1:] * 4))]
    o = Overlap(spark.createDataFrame([(i, q, s, None, None, None, None) for i, q, s in rows], SCHEMA))
    assert {tuple(r) for r in o.pairs().collect()} == {(0, 10), (0, 11), (0, 12)}
    assert {r.n_spans: r.n_pairs for r in o.spans().collect()} == {1: 1, 2: 1, 4: 1}


def test_a_name_stays_a_name_at_every_share(spark):
    """Hansen stands in a third of the questions; German nouns, as frequent, are no names."""
    name = lambda i: "".join("bdfgk"[i // 5**k % 5] + "aeiou"[i // 5**k % 5] for k in range(3)).capitalize()
    topics = [f"{i} crews" for i in range(60)]
    rows = [(i, f"What recall does Hansen report for {t}?", "calibration") for i, t in enumerate(topics)]
    rows += [(100 + i, f"What yield does {name(i)} report for {t}?", "calibration") for i, t in enumerate(topics)]
    rows += [(200 + i, f"Welchen Wert nennt {name(60 + i)} unter der Bedingung {t}?", "calibration") for i, t in enumerate(topics)]
    rows += [(300, "What recall does Hanson report for 1 crews?", "golden"), (301, "what recall does hanson report for 2 crews", "golden"), (302, "WHAT RECALL DOES HANSN REPORT FOR 3 CREWS?", "golden")]
    rows += [(310, rows[0][1].lower(), "golden"), (311, rows[125][1].replace("Bedingung", "Bedinung"), "golden"), (312, rows[126][1].replace("Bedingung", "Bedignung").lower(), "golden")]
    got = Overlap(spark.createDataFrame([(i, q, s, None, None, None, None) for i, q, s in rows], SCHEMA)).pairs().collect()
    assert {tuple(r) for r in got} == {(0, 310), (205, 311), (206, 312)}
