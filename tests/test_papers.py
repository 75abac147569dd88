import pytest
from pyspark.sql import functions as F

from marginalia.operators.evaluation import calibrate, dimension_coverage, effective_threshold, generation_metrics, locator_metrics, score_contract
from marginalia.operators.overview import merge_overview, overview_evidence, with_structural
from marginalia.operators.rerank import term_overlap
from marginalia.operators.terminology import definitions, terminology


def test_terminology(spark):
    rows = [
        ("a", "The Food and Drug Administration (FDA) met. We used retrieval augmented generation (RAG).", None), ("a", "BERT (Bidirectional Encoder Representations from Transformers) wins.", None),
        ("b", None, "Random Access Generators (RAG)"), ("b", "Type 2 diabetes (TD) and a plain note (see) here. Machine Learning (AI)", None), ("c", "", "Multi-Agent Systems (MA-S)"),
    ]
    found = definitions(spark.createDataFrame(rows, "paper string, text string, title string"))
    assert {(r.acronym, r.phrase) for r in found.collect()} == {
        ("FDA", "Food and Drug Administration"), ("RAG", "retrieval augmented generation"), ("RAG", "Random Access Generators"), ("BERT", "Bidirectional Encoder Representations from Transformers"), ("MA-S", "Multi Agent Systems"),
    }
    assert {r.acronym for r in terminology(found).collect()} == {"FDA", "BERT", "MA-S"}
    scoped = terminology(found, spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, paper string"))
    assert {(r.query_id, r.acronym, r.phrase) for r in scoped.where("acronym = 'RAG'").collect()} == {(1, "RAG", "retrieval augmented generation"), (2, "RAG", "Random Access Generators")}


def chunk(i, paper, page, index, section, text):
    return (i, paper, f"Title of {paper}", page, index, section, text)


def test_overview(spark):
    long = " Filling words make this passage as long as it has to be to count as one that stands for a paper, and no more." * 2
    rows = [
        chunk("o1", "x", 1, 0, "Intro", "We propose a thing." + long), chunk("o2", "x", 1, 1, "Intro", "We propose and we evaluate it." + long), chunk("o3", "x", 1, 2, "Intro", "Nothing is said." + long),
        chunk("ab", "x", 2, 0, "**Abstract**", "Plain." + long), chunk("co", "x", 9, 0, "Conclusions", "Plain." + long), chunk("short", "x", 1, 3, "Abstract", "We propose."),
        chunk("li", "x", 3, 0, "Body", "The dimensions we use: cost, speed, size and taste."), chunk("y1", "y", 1, 0, "Abstract", "Plain." + long),
    ]
    chunks = spark.createDataFrame(rows, "id string, paper string, title string, page int, chunk_index int, section string, text string")
    asked = spark.createDataFrame([(1, "Give an overview of title x"), (2, "Which dimensions does x use?"), (3, "How fast is it?"), (4, "Summarise everything")], "query_id int, text string")
    out = overview_evidence(asked, chunks).orderBy("query_id", "paper", "place").collect()
    assert [(r.query_id, r.id) for r in out if r.query_id < 4] == [(1, "o2"), (1, "ab"), (1, "co"), (1, "o1"), (2, "li")]
    assert {r.paper for r in out if r.query_id == 4} == {"x", "y"}
    found = spark.createDataFrame([(1, "zz", "x", 1), (1, "other", "y", 2), (2, "zz", "x", 1), (3, "zz", "x", 1)], "query_id int, id string, paper string, place int")
    merged = merge_overview(overview_evidence(asked.where("query_id < 4"), chunks), found, 5, 3).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.id) for r in merged] == [(1, "o2"), (1, "ab"), (1, "co"), (2, "li"), (3, "zz")]
    own = spark.createDataFrame([(1, "r", 1)], "query_id int, id string, place int")
    more = spark.createDataFrame([(1, "r", 1), (1, "c", 2), (1, "d", 3)], "query_id int, id string, place int")
    over = overview_evidence(asked.where("query_id = 1"), chunks)
    assert [r.id for r in with_structural(own, over, more, 6).orderBy("place").collect()] == ["r", "o2", "ab", "co", "o1", "c"]


def test_generation_and_locators(spark):
    cases = spark.createDataFrame(
        [(1, "answered", "answered", True, "passed", 2, 1, True), (2, "answered", "abstained", None, None, 3, 1, False), (3, "abstained", "abstained", None, None, 1, 0, None), (4, "abstained", "answered", True, "failed", 2, 0, None), (5, "answered", None, None, None, None, None, None)],
        "case_id int, expected string, actual string, references_valid boolean, support string, model_calls int, recovery_rounds int, recovery_success boolean",
    )
    schema = "case_id int, source string, page int"
    expected = spark.createDataFrame([(1, "a", 1, "d1"), (1, "a", 2, "d1"), (2, "b", None, None)], schema + ", dimension string").withColumns({"id": F.lit(None).cast("string"), "text_contains": F.lit(None).cast("string")})
    cited = spark.createDataFrame([(1, "a", 1), (4, "q", 1)], schema)
    r = generation_metrics(cases, cited, expected).first()
    assert (r.generation_cases, r.generation_failures, r.outcome_accuracy, r.false_abstentions, r.false_answers) == (5, 1, 0.4, 1, 1)
    assert (r.supported_answer_rate, r.abstention_correctness, r.citation_valid_answer_rate, r.citation_locator_precision) == (0.3333, 0.5, 0.6667, 0.5)
    assert (r.model_calls, r.recovery_attempts, r.recovery_success_rate) == (8, 2, 0.5)
    hits = spark.createDataFrame([(1, 1, "i", "z", 1, "t"), (1, 2, "j", "a", 2, "t"), (2, 1, "k", "b", 4, "t")], "case_id int, rank int, id string, source string, page int, text string")
    m = locator_metrics(expected, hits).first()
    assert (m.locator_precision, m.locator_recall, m.page_recall, m.mrr) == (0.3333, 0.3333, 0.5, 0.25)
    assert locator_metrics(expected, hits, 1).first().locator_recall == 0.0
    assert [tuple(x) for x in dimension_coverage(expected, hits).collect()] == [("a", "d1", 2, 1, 0.5)]


def test_calibration(spark):
    kinds = [("relevant", True, "red river", "red river"), ("topical_negative", False, "blue lake", "no words"), ("out_of_corpus", False, "odd one", "else")]
    rows = [(f"{q} {s}", p, s, k, v, "me") for s in ("calibration", "held_out") for k, v, q, p in kinds]
    labels = spark.createDataFrame(rows, "query string, passage string, split string, kind string, relevant boolean, annotator string")
    contract = score_contract("m", "r1", "sigmoid", "Identity")
    record = calibrate(labels, [0.1, 0.9], 0.1, term_overlap, contract)
    assert [(x["tp"], x["fp"], x["fn"], x["tn"]) for x in record["held_out"]] == [(1, 0, 0, 2), (0, 0, 1, 2)]
    assert effective_threshold(contract, 0.5, record) == 0.1 and effective_threshold(contract, 0.5) == 0.5
    for bad in (lambda: effective_threshold(contract, 1.5), lambda: effective_threshold({**contract, "model": "n"}, 0.5, record), lambda: effective_threshold(contract, 0.5, {**record, "held_out": []}), lambda: effective_threshold(contract, 0.5, {**record, "selected_threshold": 0.2}),
                lambda: calibrate(labels, [0.1], 0.2, term_overlap, contract), lambda: calibrate(labels.where("kind <> 'relevant' OR split = 'held_out'"), [0.1], 0.1, term_overlap, contract),
                lambda: calibrate(labels.withColumn("query", F.lit("same")), [0.1], 0.1, term_overlap, contract), lambda: calibrate(labels.withColumn("annotator", F.lit(" ")), [0.1], 0.1, term_overlap, contract)):
        with pytest.raises(ValueError):
            bad()
