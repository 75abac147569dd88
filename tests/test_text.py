import json

import pytest
from pyspark.sql import functions as F

from marginalia.config import ContextConfig
from marginalia.functions.display import excerpt, plain_text, score_map, without_bibliography
from marginalia.functions.passages import paragraphs, passages, sentences
from marginalia.operators.evaluation import label_problems, leaked_queries, locator_hits, paper_coverage, retrieval_metrics, threshold_metrics
from marginalia.operators.evidence import answer_payload, claims, coverage_warnings, number_evidence, reference, validate
from marginalia.operators.context import expand_context
from marginalia.operators.expand import contained, merge_intervals, neighbours, number_paragraphs, overlapping
from marginalia.operators.pages import carry_sections, guess_title, margin_signature, paragraph_rows, passage_rows, sentence_rows, strip_margins, strip_running_title
from marginalia.operators.sync import available, check_deletions, committed, obsolete, plan_sync


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_paragraphs_and_sections():
    text = "# One\n\nFirst para.\n\n## Two\nBody\n# Three ##"
    found = paragraphs(text)
    assert [(text[a:b], *names) for a, b, *names in zip(found.start, found.end, found.section, found.section_id)] == [("# One", "One", 1), ("First para.", "One", 1), ("## Two\nBody", "Two", 2), ("# Three ##", "Three", 3)]
    assert len(paragraphs(" \n ")) == 0 and paragraphs("x", "Kept", 4).section == ["Kept"]


def test_sentences_and_abbreviations():
    text = "Dr. Who went. See Fig. 2 for it. J. Doe agrees! Yes?"
    assert [text[a:b] for a, b in sentences(text)] == ["Dr. Who went.", "See Fig. 2 for it.", "J. Doe agrees!", "Yes?"]


def test_passages():
    text = "abcdefghij"
    assert [(p.start, p.end) for p in passages(text, paragraphs(text), 6, 2)] == [(0, 6), (4, 10)]
    text = "First sentence. Second sentence. Third sentence."
    got = [text[p.start : p.end] for p in passages(text, paragraphs(text), 32, 17)]
    assert got == ["First sentence. Second sentence.", "Second sentence. Third sentence."]
    two = "# A\none two\n\n# B\nthree"
    assert [p.section for p in passages(two, paragraphs(two), 300, 50)] == ["A", "B"]
    with pytest.raises(ValueError):
        passages("x", paragraphs("x"), 5, 5)
    with pytest.raises(ValueError):
        passages("ab", paragraphs("ab"), 2, 1, lambda t: [i for i in range(len(t)) for _ in range(3)])


def test_margins(spark):
    pages = [("d", 1, "A Study of Things\nBody one is here\nPage 1"), ("d", 2, "A Study of Things\nBody two is here\nPage 2"), ("d", 3, "Other\nBody three is here\n3"), ("e", 1, "A Study of Things\nonly"), ("f", 1, None), ("g", 1, "**10**:1 start"), ("g", 2, "Head 10:2 body two"), ("g", 3, "10:3 body three")]
    out = {(r.document_id, r.page): r.text for r in strip_margins(spark.createDataFrame(pages, "document_id string, page int, text string")).collect()}
    assert out[("d", 1)] == "Body one is here" and out[("d", 2)] == "Body two is here" and out[("d", 3)] == "Other\nBody three is here" and out[("e", 1)] == "A Study of Things\nonly"
    assert ("f", 1) not in out and out[("g", 2)] == "body two" and out[("g", 3)] == "body three"
    assert one(spark, margin_signature(F.lit("Vol. 12, Study 7"))) == "vol. #, study #" and one(spark, margin_signature(F.lit("page 3 of 9"))) == "<page-number>" and one(spark, margin_signature(F.lit("a 1"))) is None


def test_titles(spark):
    for text, want in (("x\n#  **My** Title ##\nmore", "My Title"), ("SHORT\nA useful line of text here", "A useful line of text here"), ("tiny", "stem"), (None, "stem"), ("ALL CAPITALS ARE NO TITLE", "stem")):
        assert one(spark, guess_title(F.lit(text).cast("string"), F.lit("stem"))) == want


def test_page_rows(spark):
    emoji = chr(0x1F600)
    df = spark.createDataFrame([(1, "d", 1, f"{emoji} intro.\n\n# Head\ntext"), (2, "d", 2, "goes on. And ends."), (3, "d", 3, None), (4, "e", 1, " ")], "page_id bigint, document_id string, page int, text string")
    rows = carry_sections(paragraph_rows(df, "page_id").join(df.drop("text"), "page_id")).orderBy("page_id", "paragraph").collect()
    assert [(r.page_id, r.start, r.end, r.section, r.section_id) for r in rows] == [(1, 0, 8, "Untitled section", 0), (1, 10, 21, "Head", 1), (2, 0, 18, "Head", 1)]
    assert [(r.page_id, r.sentence) for r in sentence_rows(df, "page_id").where("page_id = 2").collect()] == [(2, 0), (2, 1)]
    assert {r.page_id for r in passage_rows(df, "page_id", 300, 50).collect()} == {1, 2}


def test_display(spark):
    cases = {"**Bold** and _it_ `x`": "Bold and it x", "a <!-- no --> b": "a b", "[label](http://x.y) &amp; more": "label & more", "# Head\n- item\n1. one": "Head item one", "\\<u>\\_x\\_": "x", "snake_case_name": "snake_case_name"}
    for raw, want in cases.items():
        assert one(spark, plain_text(F.lit(raw))) == want
    assert one(spark, plain_text(F.lit(None).cast("string"))) == ""
    assert one(spark, without_bibliography(F.lit("Body [1] here.\n## References\n[1] Doe"))).strip() == "Body [1] here."
    assert one(spark, excerpt(F.lit("Body.\n[1] Doe, J. 2001\n[2] Roe"))) == "Body."


def test_citations(spark):
    answers = spark.createDataFrame([(1, "- **Rain** fell [E1][E2] . Sun [E3].\nNo cite was found here."), (2, "[E9] only"), (3, "Bad [e 1x] and [Doe, p. 3]. Ok [E1]."), (4, None), (5, "Twice [E1]. Again [E1]."), (6, "link [E1](x)")], "answer_id int, text string")
    got = sorted((r.answer_id, r.claim_id, r.claim, tuple(r.evidence_ids)) for r in claims(answers, "answer_id").collect())
    assert got[0] == (1, "C1", "Rain fell.", ("E1", "E2")) and got[1] == (1, "C2", "Sun.", ("E3",))
    evidence = spark.createDataFrame([(i, f"E{n}") for i in range(1, 7) for n in (1, 2, 3)], "answer_id int, evidence_id string")
    v = {r.answer_id: r for r in validate(answers, evidence, "answer_id").collect()}
    assert v[1].valid and not v[2].valid and v[2].unknown == ["E9"] and not v[3].valid and v[3].malformed and v[3].legacy and not v[4].valid and v[5].valid and v[5].repeated == ["E1"] and not v[6].valid
    assert one(spark, coverage_warnings(F.lit("Rain was strong. Sun is out [E1]. Note: this is it. Table shows:"))) == ["Rain was strong."]
    assert one(spark, reference(F.lit("T"), F.lit("s.pdf"), F.lit(3))) == "T (s.pdf), page 3" and one(spark, reference(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"))) == "Unknown document"
    rows = spark.createDataFrame([(1, "x", "t", "s", 1, 1), (1, "x", "t", "s", 1, 2), (1, None, "t", "s", 1, 3), (1, None, "t", "s", 1, 4), (1, None, "u", "s", 1, 5)], "a int, id string, text string, source string, page int, n int")
    assert sorted((r.n, r.evidence_id) for r in number_evidence(rows, "a", [F.asc("n")]).collect()) == [(1, "E1"), (3, "E2"), (5, "E3")]


def test_intervals(spark):
    spans = spark.createDataFrame([("d", "a", 0, 5), ("d", "b", 3, 9), ("d", "c", 9, 12), ("d", "e", 20, 22), ("x", "f", 0, 1)], "doc string, id string, start int, end int")
    blocks = merge_intervals(spans, ["doc"])
    assert sorted((r.doc, r.start, r.end, tuple(r.ids)) for r in blocks.collect()) == [("d", 0, 12, ("a", "b", "c")), ("d", 20, 22, ("e",)), ("x", 0, 1, ("f",))]
    inner = spark.createDataFrame([("d", "i", 1, 12), ("d", "j", 11, 13)], "doc string, id string, start int, end int")
    assert [r.id for r in contained(inner, blocks, ["doc"]).collect()] == ["i"] and {r.id for r in overlapping(inner, blocks, ["doc"]).collect()} == {"i", "j"}
    gap = merge_intervals(spans, ["doc"], joins=F.col("start") - F.col("_reach") <= 8)
    assert gap.where("doc = 'd'").count() == 1
    placed = number_paragraphs(spans.withColumn("section_id", F.lit(1)), ["doc"], ["start"])
    near = neighbours(placed.where("id = 'b'"), placed.select("doc", "position", "id", "section_id"), ["doc"], 1, same_section=True)
    assert sorted((r.id, r.distance) for r in near.collect()) == [("a", 1), ("c", 1)]


def test_context_within_budgets(spark):
    texts = {1: "# A\n\nAlpha one.\n\nBeta two.\n\nGamma three.", 2: "Delta four.\n\n# B\n\nEpsilon five."}
    pages = spark.createDataFrame([("d", p, t) for p, t in texts.items()], "document_id string, page int, text string")
    units, at = [], {}
    section = 0
    for p, t in texts.items():
        for i, part in enumerate(t.split("\n\n")):
            section += part.startswith("#")
            a = t.index(part)
            at[part] = (p, a, a + len(part), section)
            units.append(("d", p, i, a, a + len(part), section))
    paragraphs_ = spark.createDataFrame(units, "document_id string, page int, paragraph int, start int, end int, section_id int")
    schema = "query_id int, rank int, id string, document_id string, page int, start int, end int, section_id int"
    anchors = spark.createDataFrame([(1, 1, "x", "d", *at["Gamma three."]), (1, 2, "y", "d", *at["Alpha one."]), (1, 3, "x", "d", *at["Gamma three."])], schema)
    asked = spark.createDataFrame([(1, "why")], "query_id int, text string")
    run = lambda **c: [(r.page, r.text, r.kind, list(r.ranks)) for r in expand_context(anchors, pages, paragraphs_, asked, ContextConfig(**c)).orderBy("block_rank").collect()]
    # The whole first page in one block, over blank gaps; the next page's paragraph of the same section; not the next section.
    assert run() == [(1, texts[1], "anchor_context", [1, 2]), (2, "Delta four.", "expansion", [1])]
    # Anchors only, the better one first.
    assert run(paragraphs=0) == run(expansion_tokens=0) == [(1, "Gamma three.", "anchor", [1]), (1, "Alpha one.", "anchor", [2])]
    # Beta joins both anchors in one block, which needs fewer tokens; the next page doesn't fit any more.
    assert run(expansion_tokens=1) == [(1, texts[1], "anchor_context", [1, 2])]
    with pytest.raises(Exception, match="BudgetExceeded"):
        run(budget_tokens=10)
    assert expand_context(anchors.limit(0), pages, paragraphs_, asked, ContextConfig()).collect() == []



def test_sync_plan(spark):
    files = spark.createDataFrame([("h1", "a.pdf"), ("h1", "copy.pdf"), ("h2", "moved.pdf"), ("h3", "c.pdf"), ("h5", "new.pdf"), ("h6", "both.pdf"), ("h6", "third.pdf")], "digest string, path string")
    manifest = spark.createDataFrame([("h1", ["a.pdf", "copy.pdf"]), ("h2", ["b.pdf"]), ("h4", ["c.pdf"]), ("h7", ["gone.pdf"]), ("h6", ["both.pdf"])], "digest string, paths array<string>")
    plan = plan_sync(files, manifest)
    assert {r.digest: (r.action, r.n_duplicates) for r in plan.collect()} == {"h1": ("unchanged", 1), "h2": ("renamed", 0), "h3": ("modified", 0), "h4": ("replaced", 0), "h5": ("added", 0), "h6": ("moved", 1), "h7": ("deleted", 0)}
    check_deletions(plan, 0.5)
    with pytest.raises(ValueError):
        check_deletions(plan, 0.1)
    check_deletions(plan, 0.1, force=True)
    assert plan_sync(files.limit(0), manifest.limit(0)).collect() == []


def test_visibility(spark):
    chunks = spark.createDataFrame([("1", "d", "v1", "old"), ("2", "d", "v2", "old"), ("3", "x", "v1", "old"), ("4", None, "v1", "old"), ("5", "d", "v1", "old")], "id string, document_id string, document_version string, source string")
    owners = spark.createDataFrame([("1", "d", ["n", "m"], "v1"), ("2", "d", ["n"], "v1"), ("3", "d", ["n"], "v1"), ("4", "d", [], None)], "chunk_id string, document_id string, paths array<string>, document_version string")
    assert sorted((r.id, r.source, r.document_id) for r in committed(chunks, owners).collect()) == [("1", "n", "d"), ("4", "old", "d")]
    assert [r.id for r in obsolete(chunks, owners).collect()] == ["5"]
    hits = spark.createDataFrame([("1", "a", ["b", "c"]), ("2", "x", None), ("3", "c", ["a"])], "id string, source string, aliases array<string>")
    assert sorted((r.id, r.source) for r in available(hits, spark.createDataFrame([("c",), ("b",)], "path string")).collect()) == [("1", "b"), ("3", "c")]


def test_metrics(spark):
    scored = spark.createDataFrame([(0.5, True), (0.49, True), (0.6, False), (0.1, False), (None, True), (0.9, None)], "score double, relevant boolean")
    r = threshold_metrics(scored, [0.5, 2.0]).orderBy("threshold").collect()
    assert tuple(r[0])[1:5] == (1, 1, 1, 1) and r[0].precision == 0.5 and r[1].precision is None
    cases = spark.createDataFrame([("1", "answered", 1), ("2", "answered", 1), ("3", "abstained", 0)], "case_id string, expected string, n_expected int")
    expected = spark.createDataFrame([("1", "a", 3, None, None), ("2", "b", 1, None, "needle")], "case_id string, source string, page int, id string, text_contains string")
    hits = spark.createDataFrame([("1", 1, "x", "a", 2, ""), ("1", 2, "y", "a", 3, ""), ("2", 1, "z", "b", 1, "hay"), ("3", 1, "w", "a", 3, "")], "case_id string, rank int, id string, source string, page int, text string")
    marked = locator_hits(hits, expected)
    m = retrieval_metrics(cases, marked).first()
    assert (m.retrieval_cases, m.recall, m.mrr, m.unmatched_fraction, m.negative_cases_with_evidence, m.negative_evidence_blocks) == (2, 0.5, 0.25, 0.6667, 1, 1)
    assert sorted(tuple(r) for r in paper_coverage(expected, marked).collect()) == [("a", 1, 1, 1.0), ("b", 1, 0, 0.0)]
    labels = spark.createDataFrame([("q", "p", "calibration", "relevant", True, "x"), ("q", "p", "calibration", "relevant", False, "x"), (" Q ", "z", "held_out", "odd", True, "")], "query string, passage string, split string, kind string, relevant boolean, annotator string")
    assert {r.problem: r.n for r in label_problems(labels).collect()} == {"missing_field": 1, "label_and_kind_disagree": 2, "duplicate_label": 1}
    assert [tuple(r) for r in leaked_queries(labels).collect()] == [("q", 2)]
    assert json.loads("{}") == {}


def test_excerpts_titles_scores_and_payload(spark):
    show = lambda t: one(spark, excerpt(F.lit(t)))
    assert show("Prose here. doi: [10.1/x](http://x) [1] Doe-Roe wrote. [2] Roe too.") == "Prose here." and show("One citation [1] Doe only.") == "One citation [1] Doe only."
    assert show("JANE DOE, Example University\n\nhttps://doi.org/10.1/x\n\nWe show &amp; tell.\n\nhttps://doi.org/10.1/y") == "We show & tell. https://doi.org/10.1/y"
    assert show("JANE DOE, Example University\nAbstract of it.\n\n© 2020 Copyright held by all\n\nMore.") == "Abstract of it. More." or show("JANE DOE, Example University\nAbstract of it.") == ""
    title = F.lit("A *Study* of River Floods")
    assert one(spark, strip_running_title(F.lit("## A study of river-floods ** 12:3  Body"), title)) == "Body" and one(spark, strip_running_title(F.lit("A study of lakes"), title)) == "A study of lakes"
    assert one(spark, strip_running_title(F.lit("Two words here"), F.lit("Two words"))) == "Two words here"
    pages = spark.createDataFrame([("d", 1, "A study of River Floods 1\nBody"), ("d", 2, None)], "document_id string, page int, text string")
    assert [r.text for r in strip_margins(pages, spark.createDataFrame([("d", "A Study of River Floods")], "document_id string, title string")).collect()] == ["Body"]
    row = spark.createDataFrame([(1.0, None, 2.0, "x")], "rrf_score double, dense_score double, distance double, other string")
    assert row.select(score_map(row.columns).alias("m")).first().m == {"rrf_score": 1.0, "distance": 2.0}
    answers = spark.createDataFrame([(1, "answered", "Rain fell [E2]. It was cold. Wind [E10]."), (2, "abstained", "x [E1]")], "k int, status string, text string")
    evidence = spark.createDataFrame([(1, f"E{i}", None, "a.pdf", 3, f"**text** {i}", i - 1, 0, 5) for i in (1, 2, 10)], "k int, evidence_id string, title string, source string, page int, text string, chunk_index int, character_start int, character_end int")
    out = {r.k: r for r in answer_payload(answers, evidence, "k").collect()}
    assert [(x.id, x.reference, x.display_text, x.passage) for x in out[1].references] == [("E2", "a.pdf, page 3", "text 2", 2), ("E10", "a.pdf, page 3", "text 10", 10)]
    assert out[1].warnings == ["It was cold."] and (out[2].answer, out[2].references, out[2].warnings) == ("", [], [])
