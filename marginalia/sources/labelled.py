"""Golden question sets and relevance labels from JSON, and report files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

GOLDEN = "version int, name string, cases array<struct<id:string,question:string,expected:string,paper:string,evidence:array<struct<source:string,page:int,id:string,text_contains:string,dimension:string>>>>"
LABELS = "snapshot_revision string, examples array<struct<query:string,passage:string,split:string,kind:string,relevant:boolean,annotator:string,source:string,page:int>>"


def golden_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases (case_id, question, expected, paper, n_expected) and expected locators (case_id, source, page, id, text_contains, dimension).

    Raises ValueError naming the first rule that is broken: version 1, unique ids, questions, known outcomes, evidence
    with answered cases only, valid locators.
    """
    data = spark.read.schema(GOLDEN).json(path, multiLine=True)
    cases = data.selectExpr("version", "explode_outer(cases) AS c").selectExpr("version", "c.*")
    rules = {
        "the set must be of version 1": "version IS NULL OR version <> 1",
        "every case needs an id": "id IS NULL OR id = ''",
        "every case needs a question": "question IS NULL OR trim(question) = ''",
        "a case is answered or abstained": "expected IS NULL OR expected NOT IN ('answered', 'abstained')",
        "an answered case needs evidence, an abstained one has none": "(expected = 'answered') <> (size(coalesce(evidence, array())) > 0)",
        "a locator needs a source and a positive page": "exists(evidence, e -> e.source IS NULL OR e.source = '' OR e.page IS NULL OR e.page <= 0)",
    }
    found = cases.selectExpr(*(f"count_if({rule}) AS r{i}" for i, rule in enumerate(rules.values())), "count(id) - count(DISTINCT id) AS repeated", "count(*) AS n").first()
    broken = [text for i, text in enumerate(rules) if found[f"r{i}"]]
    if not found["n"] or broken or found["repeated"]:
        raise ValueError("; ".join(broken) or ("case ids repeat" if found["repeated"] else "the set is empty"))
    return (
        cases.selectExpr("id AS case_id", "question", "expected", "paper", "size(coalesce(evidence, array())) AS n_expected"),
        cases.selectExpr("id AS case_id", "explode(evidence) AS e").selectExpr("case_id", "e.*"),
    )


def relevance_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows as they stand; :func:`marginalia.operators.evaluation.label_problems` says what is wrong with them."""
    return spark.read.schema(LABELS).json(path, multiLine=True).selectExpr("explode(examples) AS e").selectExpr("e.*")


def write_report(path: str | Path, report: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
