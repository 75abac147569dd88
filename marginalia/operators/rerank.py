"""Scoring question and passage pairs with a pluggable model.

Offline there is no cross-encoder: :func:`term_overlap` is a named stand-in, the
likeness of term sets, and says nothing about a model's quality.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.terms import jaccard, terms

BATCH = 16


def term_overlap(question: Column, passage: Column) -> Column:
    return jaccard(F.array_distinct(terms(question)), F.array_distinct(terms(passage)))


def model_score(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = BATCH) -> Callable[[Column, Column], Column]:
    """A column function around a pair model that ``load`` makes once a worker; scores must be finite and one a pair."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for q, p in parts:
            pairs = list(zip(q.fillna(""), p.fillna("")))
            found = [float(s) for at in range(0, len(pairs), batch) for s in predict(pairs[at : at + batch])]
            if len(found) != len(pairs) or not all(math.isfinite(s) for s in found):
                raise ValueError("the reranker must give one finite score a pair")
            yield pd.Series(found)

    return score


def transformed(score: Column, transform: str) -> Column:
    """``raw`` and ``model-default`` leave a score, ``sigmoid`` maps it to (0, 1)."""
    if transform not in ("model-default", "raw", "sigmoid"):
        raise ValueError("the transform must be model-default, raw or sigmoid")
    return 1.0 / (1.0 + F.exp(-score)) if transform == "sigmoid" else score


def rerank(candidates: DataFrame, question: str, passage: str, score: Callable[[Column, Column], Column] = term_overlap) -> DataFrame:
    return candidates.withColumn("reranker_score", score(F.col(question), F.col(passage)))
