"""The whole search: questions to chosen evidence, many questions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import ContextConfig, RetrievalConfig
from marginalia.functions.terms import terms
from marginalia.operators.context import expand_context, utf8_bytes
from marginalia.operators.fusion import budget, reciprocal_rank_fusion, reserve_candidates
from marginalia.operators.lexical import bm25
from marginalia.operators.questions import ONE_PAPER
from marginalia.operators.rerank import rerank, term_overlap
from marginalia.operators.select import by_threshold, cap_per_paper, mmr, rerank_order
from marginalia.runtime import Scratch

SENT_IDS = 200_000  # listed chunks whose ids are sent to every task, so that only their texts are shuffled
_LIST = "query_id", "variant", "list_no", "id", "rank", "distance", "dense_score", "bm25_score"


def ranked_lists(asked: DataFrame, chunks: DataFrame, config: RetrievalConfig, dense: DataFrame | None) -> DataFrame:
    """The ranked lists of all variants of all questions, each within its budget; ``list_no`` is 2 * variant, and 1 more for words.

    ``asked``: query_id, variant (0: the question itself), text, queries (variants of the question in all) and, for restricted
    questions, scope.
    """
    none = F.lit(None).cast("double")
    lists = []
    if dense is not None:
        near = dense if "variant" in dense.columns else dense.withColumn("variant", F.lit(0))
        near = near.join(asked.select("query_id", "variant", "queries"), ["query_id", "variant"]).where(F.col("rank") <= budget(config.dense_candidates, F.col("queries"), F.col("variant")))
        lists.append(near.select("query_id", "variant", (2 * F.col("variant")).alias("list_no"), "id", "rank", "distance", "dense_score", none.alias("bm25_score")))
    if config.mode != "dense":
        key = F.struct("query_id", "variant", "queries")
        words = bm25(asked.withColumn("query_id", key), chunks, config.bm25_candidates, scope="scope" if "scope" in asked.columns else None)
        words = words.select("query_id.*", "id", "rank", "bm25_score").where(F.col("rank") <= budget(config.bm25_candidates, F.col("queries"), F.col("variant")))
        lists.append(words.select("query_id", "variant", (2 * F.col("variant") + 1).alias("list_no"), "id", "rank", none.alias("distance"), none.alias("dense_score"), "bm25_score"))
    if not lists:
        raise ValueError("dense mode needs a list of nearest vectors")
    ranked = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return ranked.join(asked.select("query_id", "variant", F.when(F.col("variant") == 0, 1.0).otherwise(1.0 / F.greatest(F.col("queries") - 1, F.lit(1))).alias("weight")), ["query_id", "variant"])


def search(
    questions: DataFrame, chunks: DataFrame, config: RetrievalConfig, *, dense: DataFrame | None = None, variants: DataFrame | None = None, score: Callable[[Column, Column], Column] = term_overlap
) -> DataFrame:
    """(query_id, place, id, source, page, text, rrf_score, reranker_score): the evidence chosen for each question.

    ``questions``: query_id, text and, to restrict a question to one paper, scope; a question that speaks of "this paper" without
    naming one finds nothing.  ``dense`` is a ranked list (query_id, id, rank, distance, dense_score, and variant where there are several)
    of nearest vectors, left out where there are no vectors.  ``variants`` (query_id, variant from 1, text) are further
    forms of a question: they share half of its budgets and a weight of 1, and can't crowd out what the question itself found.  Modes: ``dense``
    keeps the list of vectors (fused over variants), ``hybrid`` fuses, ``hybrid-rerank`` also scores, thresholds and diversifies.
    """
    none = F.lit(None).cast("double")
    scratch = Scratch(chunks.sparkSession, "search")
    scoped = "scope" in questions.columns
    named = F.col("scope").isNotNull() if scoped else F.lit(False)
    original = questions.where(named | ~F.coalesce(F.col("text").rlike(ONE_PAPER), F.lit(False))).select("query_id", F.lit(0).alias("variant"), "text", *(["scope"] if scoped else []))
    asked = original
    if variants is not None:
        more = variants.select("query_id", F.col("variant").cast("int").alias("variant"), "text")
        asked = asked.unionByName(more.join(original.select("query_id", *(["scope"] if scoped else [])), "query_id"))
    asked = asked.withColumn("queries", F.count(F.lit(1)).over(W.partitionBy("query_id")).cast("int"))
    # The lists are short, k rows a question: written once, so that no search runs twice.
    ranked = scratch.write(ranked_lists(asked, chunks, config, dense), "lists")
    fused = scratch.write(reciprocal_rank_fusion(ranked, k=config.rrf_k, weight=F.col("weight")), "fused")
    texts = chunks.select("id", "paper", "source", "page", "text")
    if fused.count() <= SENT_IDS:
        texts = texts.join(F.broadcast(fused.select("id").distinct()), "id", "left_semi")
    if config.mode != "hybrid-rerank":
        rows = fused.join(texts, "id")
        if config.mode == "dense" and variants is None:  # a single list keeps its own order
            rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")))
        chosen = cap_per_paper(rows, config.max_chunks_per_paper, config.final_results)
        return chosen.select("query_id", F.col("final_rank").alias("place"), "id", "source", "page", "text", "rrf_score", none.alias("reranker_score"))
    own = fused.where(F.array_min("lists") < 2).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    candidates = reserve_candidates(own, fused, config.rerank_candidates).join(fused.select("query_id", "id", "rrf_score"), ["query_id", "id"]).join(texts, "id")
    scored = rerank(candidates.join(questions.select("query_id", F.col("text").alias("_question")), "query_id"), "_question", "text", score).drop("_question")
    kept, _ = by_threshold(scored, config.reranker_min_score)
    ordered = scratch.write(kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*rerank_order()))), "scored")
    picks = mmr(ordered.withColumn("terms", F.array_distinct(terms(F.col("text")))), config.final_results, config.mmr_lambda, config.max_chunks_per_paper)
    return picks.join(ordered.drop("place"), ["query_id", "id"]).select("query_id", "place", "id", "source", "page", "text", "rrf_score", "reranker_score")


def search_with_context(
    questions: DataFrame, chunks: DataFrame, pages: DataFrame, paragraphs: DataFrame, config: RetrievalConfig, context: ContextConfig, *, count: Callable[[str], int] = utf8_bytes, fixed_tokens: int = 0, **options: object
) -> DataFrame:
    """:func:`search`, and around the chosen chunks what :func:`expand_context` lets in: blocks of page text, the best anchor's first.

    ``chunks`` also has document_id, character_start, character_end and section_id; ``options`` go to the search.
    """
    places = chunks.select("id", "document_id", F.col("character_start").alias("start"), F.col("character_end").alias("end"), "section_id")
    anchors = search(questions, chunks, config, **options).select("query_id", F.col("place").alias("rank"), "id", "page").join(places, "id")
    return expand_context(anchors, pages, paragraphs, questions, context, count=count, fixed_tokens=fixed_tokens)
