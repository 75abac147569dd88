import hashlib
import importlib
import re

import pytest
from compare import DATA, assert_same

MODULES = [importlib.import_module(f"marginalia.plans.{m}") for m in ("snapshot_queries", "search_queries", "text_queries")]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SPACE = r"\s+"  # of Unicode, as in the queries
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


def test_what_has_no_sql_is_tested_here():
    assert set(QUERIES) - set(SQL) == {"sentence_counts", "page_passages", "section_carry", "strip_page_margins", "display_text", "acronym_definitions"}


def latest_pages(spark):
    rows = spark.read.parquet(f"{DATA}/sync_pages.parquet").where("page_id IS NOT NULL").collect()
    best = {}
    for r in sorted(rows, key=lambda r: (r.loaded_at is not None, r.loaded_at)):
        best[r.page_id] = r
    return best.values()


def test_sentences_and_passages(spark):
    from marginalia.functions.passages import paragraphs, passages, sentences

    docs = {r.doc_id: [(a, b) for a, b in sentences(r.text) if b > a] if r.text else [] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_sentences, r.longest) for r in QUERIES["sentence_counts"](spark, DATA).collect()}
    assert got == {d: (len(s), max(b - a for a, b in s)) for d, s in docs.items() if s} and len(got) > 50
    want = {(r.page_id, i, p.start, p.end, p.section) for r in latest_pages(spark) if r.text and r.text.strip() for i, p in enumerate(passages(r.text, paragraphs(r.text), 300, 50))}
    assert {(r.page_id, r.passage, r.start, r.end, r.section) for r in QUERIES["page_passages"](spark, DATA).collect()} == want and len(want) > 50


def test_sections_are_carried_over_pages(spark):
    from marginalia.functions.passages import paragraphs

    want, state = set(), {}
    for r in sorted((r for r in latest_pages(spark) if r.document_id is not None), key=lambda r: (r.page is not None, r.page or 0, r.page_id)):
        name, n = state.get(r.document_id, ("Untitled section", 0))
        page = paragraphs(r.text or "")
        for i, (a, b, own, at) in enumerate(zip(page.start, page.end, page.section, page.section_id)):
            if at > (page.section_id[i - 1] if i else 0):
                name, n = own, n + 1
            want.add((r.page_id, i, a, b, name, n))
        state[r.document_id] = (name, n)
    assert {tuple(r) for r in QUERIES["section_carry"](spark, DATA).collect()} == want and len(want) > 100


def test_margins_and_display(spark):
    pages = {(r.document_id, r.page) for r in latest_pages(spark) if r.document_id is not None and r.page is not None}
    rows = QUERIES["strip_page_margins"](spark, DATA).collect()
    assert {(r.document_id, r.page) for r in rows} <= pages and len(rows) > 0.8 * len(pages) and all(r.n_chars > 0 for r in rows)
    shown = {r.doc_id: r.digest for r in QUERIES["display_text"](spark, DATA).collect()}
    plain = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text and not re.search(r"[<>*_`#\[\]\\&~!+-]|(?m:^\s*\d+[.)])", r.text)}
    assert len(plain) > 5 and all(shown[d] == hashlib.md5(" ".join(re.split(SPACE, t)).strip().encode()).hexdigest() for d, t in plain.items())
    assert QUERIES["acronym_definitions"](spark, DATA).columns == ["acronym", "phrase"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_nothing_imports_llm():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "marginalia"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+marginalia\.llm", f.read_text(), re.M), f
