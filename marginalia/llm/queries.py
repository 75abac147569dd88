"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.bpe import token_count, token_ids
from marginalia.llm.citations_top import best_citations, lay_out_citations
from marginalia.llm.overlap import Overlap
from marginalia.llm.packing import fill_containers
from marginalia.llm.splits import assign_splits, path_key, related_groups, text_key
from marginalia.llm.splitting import split_oversized
from marginalia.llm.subjects import fit, subjects_of
from marginalia.llm.topn import skipped
from marginalia.plans.tables import table

CAPACITY = 2048


def _overlap(spark: SparkSession, sf_dir: str) -> Overlap:
    return Overlap(table(spark, sf_dir, "relevance_labels_to_review"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).pairs()


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).counts()


def p2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).spans()


def p3_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_citations(table(spark, sf_dir, "citations"), table(spark, sf_dir, "sync_chunks"), 5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_topn(spark, sf_dir).select("source", "citation_id")


def p3_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups and rows that the five best of every source are found without."""
    return skipped(lay_out_citations(table(spark, sf_dir, "citations"), table(spark, sf_dir, "sync_chunks")), 5)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "sync_pages"), table(spark, sf_dir, "index_config"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("character_start IS NOT NULL").select("page_id", "chunk_index", "character_start", "character_end", "paragraph_start")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.when(F.col("longest_run") > F.col("chunk_size"), F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized"))))
    return _pieces(spark, sf_dir).select("page_id", kinds.alias("case_kind")).distinct()


def _label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_groups(table(spark, sf_dir, "relevance_labels_to_review"), "label_id", [text_key(F.col("query")), path_key(F.col("source"))])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_groups(spark, sf_dir)


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table with its split."""
    labels = table(spark, sf_dir, "relevance_labels_to_review")
    assigned = assign_splits(_label_groups(spark, sf_dir), table(spark, sf_dir, "split_targets"), "label_id")
    return labels.select("label_id").join(assigned, "label_id", "left").select("label_id", "group_id", "target_split")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(spark)(F.col("text")).alias("ids"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(table(spark, sf_dir, "documents"), "doc_id", token_count(spark)(F.col("text")), CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, tokens in them, the least possible number of containers, share of space used."""
    per = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    out = per.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"))
    return out.withColumn("least_containers", F.ceil(F.col("n_tokens") / CAPACITY)).withColumn("fill", F.try_divide(F.col("n_tokens"), F.col("n_containers") * CAPACITY))


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its subjects."""
    documents = table(spark, sf_dir, "documents")
    model = fit(table(spark, sf_dir, "subject_examples"), documents, table(spark, sf_dir, "subjects"))
    return subjects_of(documents.select("doc_id", "text"), model).select("doc_id", "subjects")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", F.explode("subjects").alias("subject"))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject; null counts those without any."""
    return p8_subjects(spark, sf_dir).select(F.explode_outer("subjects").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_spans": p2_spans, "p3_topn": p3_topn, "p3_found": p3_found, "p3_skips": p3_skips, "p4_pieces": p4_pieces, "p4_found": p4_found, "p5_found": p5_found, "p5_splits": p5_splits, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_subjects": p8_subjects, "p8_composition": p8_composition}

_TOP = """
WITH c AS (SELECT * FROM (
    SELECT citation_id, chunk_id, map_extract_value(scores, 'reranker_score') AS a, map_extract_value(scores, 'rrf_score') AS b,
      row_number() OVER (PARTITION BY citation_id ORDER BY loaded_at DESC NULLS LAST, chunk_id DESC) AS rn
    FROM citations WHERE citation_id IS NOT NULL) WHERE rn = 1),
s AS (SELECT * FROM (
    SELECT chunk_id, source, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, source DESC) AS rn
    FROM sync_chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1 AND source IS NOT NULL AND trim(source) <> ''),
r AS (
  SELECT source, citation_id, a AS reranker_score, CASE WHEN b IS NULL OR NOT isfinite(b) THEN 0.0::DOUBLE ELSE b END AS rrf_score
  FROM c JOIN s USING (chunk_id) WHERE a IS NOT NULL AND isfinite(a)),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY reranker_score DESC, rrf_score DESC, citation_id) AS INTEGER) AS rank FROM r)
"""

_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_OVERSIZED = f"""
WITH o AS (
  SELECT page_id, chunk_size, list_max(list_transform(string_split_regex(text, '{_BLANK}'), lambda x: length(x))) AS run
  FROM sync_pages JOIN index_config USING (config_id) WHERE length(text) > chunk_size)
SELECT DISTINCT page_id, 'oversized' AS case_kind FROM o
UNION ALL SELECT DISTINCT page_id, 'unbroken' FROM o WHERE run > chunk_size
"""
_QKEY = f"nullif(regexp_replace(lower(upper(query)), '{_BLANK}', '', 'g'), '')"
_SKEY = r"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(upper(trim(url_decode(replace(source, '\', '/'))))), '/(\./)+', '/', 'g'), '^\s*(\./)+', ''), '/+', '/', 'g'), '^/', ''), '')"""
_GROUPS = f"""
WITH RECURSIVE r AS (SELECT DISTINCT label_id, {_QKEY} AS q, {_SKEY} AS s FROM relevance_labels_to_review WHERE label_id IS NOT NULL),
e AS (
  SELECT label_id AS a, min(label_id) OVER (PARTITION BY q) AS b FROM r WHERE q IS NOT NULL
  UNION SELECT label_id, min(label_id) OVER (PARTITION BY s) FROM r WHERE s IS NOT NULL),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT label_id, label_id FROM r),
walk(start, node) AS (
  SELECT a, b FROM g
  UNION SELECT w.start, g.b FROM walk w JOIN g ON g.a = w.node)
SELECT node AS label_id, min(start) AS group_id FROM walk GROUP BY node
"""

SQL = {
    "p4_found": _OVERSIZED,
    "p5_found": _GROUPS,
    "p3_topn": _TOP + "SELECT source, rank, citation_id, reranker_score, rrf_score FROM o WHERE rank <= 5",
    "p3_found": _TOP + "SELECT source, citation_id FROM o WHERE rank <= 5",
}
