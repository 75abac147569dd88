import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm.subjects import Chain, Evidence, Words, fit, folds, learnt_cut, prepare, read_sentences, short_words, subjects_of

TOPICS = {
    "law": ["legal precedents", "plea agreements", "jury verdicts", "bail conditions", "tenancy contracts", "custody hearings"],
    "physics": ["photon pairs", "muon detectors", "laser cavities", "quantum dots", "plasma instabilities", "cosmic rays"],
    "sport": ["penalty kicks", "relay teams", "ski jumps", "league tables", "youth academies", "tennis serves"],
}
FRAMES = ["We examine how {} relate to {} in many cases.", "Why do {} behave so differently from {}?", "The share of {} rose while {} fell a little.", "Reviews of {} tend to skip {} altogether."]
FILLERS = ["Limitations are discussed at the end of this.", "All numbers are rounded to two digits here.", "We thank two anonymous readers for their remarks."]


def text(rng, subjects, n=10):
    out = []
    for i in range(n):
        if rng.random() < 0.2 or not subjects:
            out.append(rng.choice(FILLERS))
        else:
            s = subjects[i % len(subjects)]
            out.append(rng.choice(FRAMES).format(*rng.sample(TOPICS[s], 2)).capitalize())
    return "# Heading\n" + " ".join(out)


def sample(rng, n):
    rows = []
    for i in range(n):
        k = [[], ["law"], ["physics"], ["sport"], ["law", "sport"], ["physics"], ["law"], ["sport"]][i % 8]
        rows.append((i, text(rng, k), k))
    return rows


def known(texts):
    words = Words(grow=True)
    return read_sentences(texts, words, np.zeros(0, bool)), words


def test_sentences_headings_lists_and_references():
    s, w = known(["# Methods\nDr. Smith et al. [3] found a small e.g. effect here. It was stable over many years!\n\n- one item of the list here\n* another item of the list here\nReferences\n[1] A list of old papers that go on.\n", None, "", "too short here"])
    assert np.bincount(s.document, minlength=4).tolist() == [4, 0, 0, 0]
    assert prepare("Durch-\nsicht\r\nx") == "durchsicht\nx"
    assert short_words(w)[w["dr"]] and not short_words(w)[w["smith"]]


def test_text_behind_a_list_of_references_stays():
    text = "Some text here.\n## References\n[1] Derval, T. (2013). Notes.\nand more of it\n\n[2] Givin, N. (1998). Notes.\n\n## Appendix\nFurther measurements follow here.\n"
    assert prepare(text).split() == "some text here. ## appendix further measurements follow here.".split()
    assert prepare("Literatur\nDerval (2013), Notizen.\n\nAuch diese Seite hat noch Text.").split() == "auch diese seite hat noch text.".split()
    assert prepare("a\nReferences\n1. Old papers\n2. Older papers").split() == ["a"]


def test_the_cut_is_learnt():
    rng = np.random.default_rng(1)
    share = rng.random((500, 3)).round(1)
    for true in (0.25, 0.55):
        e = Evidence(share, share, share, np.full(500, 10), np.zeros(500))
        assert abs(learnt_cut(e, (share > true).astype(float)) - true) < 0.06


def test_beam_finds_the_most_probable_combination():
    rng = np.random.default_rng(0)
    e = Evidence(rng.random((40, 3)), rng.random((40, 3)), rng.random((40, 3)), np.full(40, 9), np.zeros(40))
    x = 11 + 3
    chain = Chain([2, 0, 1], [rng.normal(size=x) for _ in range(3)], [(1.3, 0.1)] * 3, 0.3, beam=8)
    got = chain.decode(e)
    from itertools import product

    from marginalia.llm.subjects import _design

    for d in range(40):
        best = None
        for combo in product((0.0, 1.0), repeat=3):
            total, decided = 0.0, np.zeros((1, 3))
            for at, j in enumerate(chain.order):
                p = 1 / (1 + np.exp(-chain.score(at, _design(e.rows(slice(d, d + 1)), j, decided, chain.cut))[0]))
                total += np.log(p if combo[j] else 1 - p)
                decided[0, j] = combo[j]
            if best is None or total > best[0]:
                best = (total, combo)
        assert tuple(got[d]) == best[1]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(3)
    examples = spark.createDataFrame([(i, t, k) for i, t, k in sample(rng, 160)] + [(900, None, ["law"]), (901, "x", None)], "example_id bigint, text string, subjects array<string>")
    corpus = sample(rng, 300)
    documents = spark.createDataFrame([(i, t) for i, t, _ in corpus] + [(1000, None), (1001, ""), (1002, " \n "), (1003, "law " * 50_000), (1004, corpus[1][1])], "doc_id bigint, text string")
    subjects = spark.createDataFrame([(s, "") for s in TOPICS] + [(None, None)], "subject string, description string")
    return fit(examples, documents, subjects), documents, corpus, examples, subjects


def test_held_out_accuracy(fitted):
    model, documents, corpus, _, _ = fitted
    out = {r.doc_id: r.found for r in subjects_of(documents.withColumn("found", F.lit("clash")), model, out="found").collect()}
    right = sum(sorted(out[i]) == sorted(k) for i, _, k in corpus)
    assert right / len(corpus) > 0.97
    assert out[1000] == out[1001] == out[1002] == [] and out[1004] == out[1]


def test_real_examples_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/subject_examples.parquet").orderBy("example_id")
    rows = table.collect()
    part = folds(len(rows))
    ids = [r.example_id for r, f in zip(rows, part) if f == 0]
    held = F.col("example_id").isin(ids)
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(table.where(~held), documents, spark.read.parquet("/root/testdata/sf0.01/subjects.parquet"))
    out = subjects_of(table.where(held), model, out="found").collect()
    hits = sum(len(set(r.found) & set(r.subjects)) for r in out)
    assert hits / sum(len(r.found) for r in out) > 0.95 and hits / sum(len(r.subjects) for r in out) > 0.9


def test_empty_tables(spark, fitted):
    model, documents, _, examples, subjects = fitted
    assert subjects_of(documents.limit(0), model).collect() == []
    assert all(r.subjects == [] for r in subjects_of(documents, fit(examples.limit(0), documents, subjects)).collect())
    assert fit(examples, documents.limit(0), subjects).chain is not None
