"""Questions before the search, as relations: corrections, aliases, variants, instruction."""

from __future__ import annotations

import re
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.terms import word_family

# Words a misspelt word may be corrected to, and how near and how clearly nearest it must be.
CORRECTABLE = ("comparison", "contribute", "dimension", "evaluation", "generation", "hallucination", "methodology", "performance", "retrieval", "trustworthiness")
NEAR, CLEARLY, KNOWN_FROM, LEAST_LETTERS = 0.78, 0.035, 5, 6
# Fixed value: what goes before a query for the model that was trained so.
_INSTRUCTED = {"BAAI/bge-small-en-v1.5": "Represent this sentence for searching relevant passages: "}
# Fixed value: how a question speaks of one paper.
ONE_PAPER = r"(?i)\bthis\s+(?:paper|article|study|survey)\b"
MOST_VARIANTS = 2
_WORD = r"(?<![\p{L}\p{N}_./+#-])([\p{L}\p{N}][\p{L}\p{N}_./+#-]*)"


def instruction(model: str, mode: str = "auto") -> str:
    """What goes before a query for exactly the model that was trained so; passages get nothing."""
    if mode not in ("auto", "off"):
        raise ValueError("the query instruction is auto or off")
    return _INSTRUCTED.get(model, "") if mode == "auto" else ""


def needs_scope(question: str, papers: Iterable[str] = ()) -> bool:
    """Whether a question speaks of one paper that wasn't named."""
    return bool(re.search(ONE_PAPER, question)) and not list(papers)


def _likeness(words: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, b, a).ratio() for a, b in zip(words, others)], dtype="float64")


def corrections(questions: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(``query_id``, ``text``) of the questions that a correction changes.

    Lower-case words of LEAST_LETTERS or more that the corpus (``frequencies``: term, cf) doesn't have become the one
    correctable word clearly nearest, if the corpus has that KNOWN_FROM times.  Only the questions' unknown words meet
    the few correctable ones.
    """
    words = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(1)))).alias("word"))
    words = words.where(F.col("word").rlike(rf"^\p{{Ll}}{{{LEAST_LETTERS},}}$")).withColumn("term", word_family(F.col("word")))
    unknown = words.join(frequencies.select("term"), "term", "left_anti")
    targets = frequencies.where(F.col("term").isin(*CORRECTABLE) & (F.col("cf") >= KNOWN_FROM)).select(F.col("term").alias("target"))
    pairs = unknown.select("word", "term").distinct().crossJoin(F.broadcast(targets))  # no more targets than CORRECTABLE names
    scored = pairs.withColumn("near", F.pandas_udf(_likeness, "double")("term", "target")).where(F.col("near") >= NEAR)
    order = W.partitionBy("word").orderBy(F.desc("near"), F.desc("target"))
    best = scored.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("near").over(order)).where("_n = 1")
    best = best.where(F.col("_next").isNull() | (F.col("near") - F.col("_next") >= CLEARLY)).select("word", "target")
    changes = unknown.join(best, "word").groupBy("query_id").agg(F.collect_list(F.struct("word", "target")).alias("_changes"))
    swap = lambda text, c: F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_./+#-])\Q"), c["word"], F.lit(r"\E(?![\p{L}\p{N}_./+#-])")), c["target"])
    return questions.join(changes, "query_id").select("query_id", F.aggregate("_changes", F.col("text"), swap).alias("text"))


def aliases(questions: DataFrame, terminology: DataFrame) -> DataFrame:
    """(``query_id``, ``acronym``, ``text``): a question with the other name in brackets behind the term it has.

    ``terminology``: acronym, phrase, one phrase an acronym, and query_id where it differs by question.  The acronym must be written as
    it is, the phrase may differ in case and hyphens; of both in one question the acronym is explained.
    """
    keys = ["query_id"] if "query_id" in terminology.columns else []
    met = questions.select("query_id", "text").join(terminology, keys) if keys else questions.select("query_id", "text").crossJoin(terminology)
    edge, behind = r"(?<![\p{L}\p{N}_./+#-])", r"(?![\p{L}\p{N}_/+#-]|\.[\p{L}\p{N}_])"
    quoted = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    short = F.concat(F.lit(f"(?s)^(.*?{edge}"), quoted(F.col("acronym")), F.lit(f"{behind})"))
    spaced = F.array_join(F.transform(F.split("phrase", r"\s+"), quoted), r"[\s-]+")
    long = F.concat(F.lit(f"(?s)^(.*?{edge}(?i:"), spaced, F.lit(f"){behind})"))
    explain = lambda pattern, other: F.regexp_replace("text", pattern, F.concat(F.lit("$1 ("), F.regexp_replace(other, r"([\\$])", r"\\$1"), F.lit(")")))
    has_short, has_long = F.regexp_like("text", short), F.regexp_like("text", long)
    out = met.where(has_short | has_long)
    return out.select("query_id", "acronym", F.when(has_short, explain(short, F.col("phrase"))).otherwise(explain(long, F.col("acronym"))).alias("text"))


def variants(questions: DataFrame, *, subqueries: DataFrame | None = None, corrected: DataFrame | None = None, aliased: DataFrame | None = None, most: int = MOST_VARIANTS) -> DataFrame:
    """(``query_id``, ``variant`` from 1, ``text``): up to ``most`` (MOST_VARIANTS at most) other forms of each question.

    Planned subqueries (query_id, text, place) come first, then the corrected form, then aliases by acronym.  Forms that differ
    from the question, or from an earlier one, in case or white space only are left out.
    """
    offered = [(subqueries, 0, F.col("place") if subqueries is not None else None), (corrected, 1, F.lit(0)), (aliased, 2, F.lit(0))]
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = questions.select("query_id", "text", F.lit(-1).alias("_kind"), F.lit(0).alias("_place"), F.lit("").alias("_name"))
    for df, kind, place in offered:
        if df is not None:
            name = F.col("acronym") if "acronym" in df.columns else F.lit("")
            own = df.join(questions.select("query_id"), "query_id", "left_semi")
            rows = rows.unionByName(own.select("query_id", "text", F.lit(kind).alias("_kind"), place.cast("int").alias("_place"), name.alias("_name")))
    order: list[Column] = [F.asc("_kind"), F.asc("_place"), F.asc("_name"), F.asc("text")]
    once = rows.withColumn("_key", key(F.col("text"))).where("_key <> '' OR _kind = -1").withColumn("_n", F.row_number().over(W.partitionBy("query_id", "_key").orderBy(*order))).where("_n = 1 AND _kind >= 0")
    at = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return once.withColumn("variant", at).where(F.col("variant") <= min(most, MOST_VARIANTS)).select("query_id", "variant", "text")
