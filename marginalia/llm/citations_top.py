"""Citations ranked for every stored source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.topn import Clustered, top_n, write_clustered
from marginalia.runtime import Scratch, hot_keys, join_with_hot


def _finite(c):
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c + F.lit(0.0))  # + 0.0: no negative zero


def lay_out_citations(citations: DataFrame, chunks: DataFrame) -> Clustered:
    """The rankable citations clustered by stored source.

    Of rows with the same citation id, and of chunks with the same chunk id, the
    one loaded last counts (null ``loaded_at`` is earliest; among equals the one
    with the greatest values, the same on every run).  The group is the stored source
    of the citation's chunk, exactly; null and blank sources and unknown chunks give
    none.  Only a finite reranker score is ranked; an absent, null or non-finite
    ``rrf_score`` is 0.
    """
    scratch = Scratch(citations.sparkSession, "topn")
    latest = (
        citations.where(F.col("citation_id").isNotNull())
        .select("citation_id", F.struct("loaded_at", "chunk_id", F.col("scores")["reranker_score"].alias("a"), F.col("scores")["rrf_score"].alias("b")).alias("v"))
        .groupBy("citation_id")
        .agg(F.max("v").alias("v"))
        .select("citation_id", "v.chunk_id", _finite(F.col("v.a")).alias("_score"), F.coalesce(_finite(F.col("v.b")), F.lit(0.0)).alias("_second"))
        .where(F.col("_score").isNotNull() & F.col("chunk_id").isNotNull())
    )
    stored = (
        chunks.where(F.col("chunk_id").isNotNull())
        .groupBy("chunk_id")
        .agg(F.max(F.struct("loaded_at", "source")).alias("v"))
        .select("chunk_id", F.col("v.source").alias("_group"))
        .where(F.col("_group").isNotNull() & F.col("_group").rlike(r"(?U)\S"))
    )
    hot = hot_keys(citations.select("chunk_id"), "chunk_id", 200)
    items = join_with_hot(latest, stored, "chunk_id", hot).select("_group", "_score", "_second", F.col("citation_id").alias("_id"))
    return write_clustered(items, scratch, "citations")


def best_citations(citations: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """(``source``, ``rank``, ``citation_id``, ``reranker_score``, ``rrf_score``) of the N best citations of each stored source, by the rules of :func:`lay_out_citations`."""
    return top_n(lay_out_citations(citations, chunks), n).select(
        F.col("_group").alias("source"), "rank", F.col("_id").alias("citation_id"), F.col("_score").alias("reranker_score"), F.col("_second").alias("rrf_score")
    )
