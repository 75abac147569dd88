"""Search: terms, BM25, nearest vectors, fusion, candidate reservation, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import RetrievalConfig
from marginalia.functions.terms import terms
from marginalia.operators.chunks import latest_by, latest_of_few, stored_chunks
from marginalia.operators.dense import nearest
from marginalia.operators.fusion import reciprocal_rank_fusion, reserve_candidates, variant_weights
from marginalia.operators.lexical import bm25, postings, term_frequencies
from marginalia.operators.rerank import term_overlap
from marginalia.operators.overview import overview_passages
from marginalia.operators.select import RetrievalPlan, by_threshold, cap_per_paper, mmr, rerank_order, select_by_quota, task_of
from marginalia.plans.tables import table
from marginalia.search import search

TOP = 20
EVERY = 100  # searches but bm25_topk ask with every row whose id this divides, against all rows


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return stored_chunks(table(spark, d, "sync_chunks"))


def _searched_chunks(spark: SparkSession, d: str) -> DataFrame:
    return stored_chunks(table(spark, d, "sync_chunks"), latest_of_few)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    labels = latest_by(table(spark, d, "relevance_labels_to_review").where(F.col("label_id") % EVERY == 0), "label_id")
    return labels.where("query IS NOT NULL").select(F.col("label_id").alias("query_id"), F.col("query").alias("text"), "source")


def _every_question(spark: SparkSession, d: str) -> DataFrame:
    labels = latest_of_few(table(spark, d, "relevance_labels_to_review"), "label_id")
    return labels.where("query IS NOT NULL").select(F.col("label_id").alias("query_id"), F.col("query").alias("text"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(postings(_chunks(spark, d)))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The questions of all labels."""
    return bm25(_every_question(spark, d), _searched_chunks(spark, d), TOP)


def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Questions restricted to the one paper that their source names; sources of no or several papers drop out."""
    chunks = _chunks(spark, d)
    papers = chunks.where("source IS NOT NULL").groupBy("source").agg(F.min("paper").alias("scope"), F.max("paper").alias("_last")).where("scope = _last").select("source", "scope")
    return bm25(_questions(spark, d).join(papers, "source").select("query_id", "text", "scope"), chunks, TOP, scope="scope")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return nearest(v.where(F.col("id") % EVERY == 0), v, TOP)


def dense_scoped(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return nearest(v.where(F.col("id") % EVERY == 0), v, TOP, scope="scope")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document that has a vector, asked by its vector (list 0) and by its title (list 1)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "title")
    v = _vectors(spark, d)
    asked = docs.where((F.col("id") % EVERY == 0) & F.col("title").isNotNull()).join(v.select("id"), "id", "left_semi")
    by_vector = nearest(v.join(asked.select("id"), "id", "left_semi"), v, TOP).select("query_id", F.lit(0).alias("list_no"), "id", "rank", "distance", "dense_score", F.lit(None).cast("double").alias("bm25_score"))
    by_words = bm25(asked.select(F.col("id").alias("query_id"), F.col("title").alias("text")), docs, TOP)
    nothing = F.lit(None).cast("double")
    return by_vector.unionByName(by_words.select("query_id", F.lit(1).alias("list_no"), "id", "rank", nothing.alias("distance"), nothing.alias("dense_score"), "bm25_score"))


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return reciprocal_rank_fusion(_lists(spark, d)).select("query_id", "id", "rrf_score", "distance", "bm25_score", "rank")


def rrf_weighted_variants(spark: SparkSession, d: str) -> DataFrame:
    """The two lists as an original query and a single variant's half weight."""
    w = variant_weights(3)
    return reciprocal_rank_fusion(_lists(spark, d), weight=F.when(F.col("list_no") == 0, w[0]).otherwise(w[1])).select("query_id", "id", "rrf_score", "rank")


def rerank_reserve(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    return reserve_candidates(lists.where("list_no = 0"), reciprocal_rank_fusion(lists), 11)


def rerank_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every label's query and passage scored by the offline stand-in."""
    labels = latest_by(table(spark, d, "relevance_labels_to_review"), "label_id")
    return labels.select("label_id", F.round(term_overlap(F.col("query"), F.col("passage")), 6).alias("reranker_score"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Citations as ranked candidates of their answer."""
    c = latest_by(table(spark, d, "citations").select("citation_id", "answer_id", "document_id", "source", "text", "scores", "loaded_at"), "citation_id")
    score = F.col("scores")["reranker_score"]
    finite = c.where(score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")) & F.col("answer_id").isNotNull())
    rows = finite.select(F.col("answer_id").alias("query_id"), F.col("citation_id").alias("id"), F.coalesce("document_id", "source", F.lit("")).alias("paper"), score.alias("reranker_score"), F.coalesce(F.col("scores")["rrf_score"], F.lit(0.0)).alias("rrf_score"), "text")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*rerank_order())))


def threshold_and_paper_cap(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = by_threshold(_candidates(spark, d), 0.3)
    return cap_per_paper(kept, 2, 5).select("query_id", "id", "final_rank")


def rejected_candidates(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = by_threshold(_candidates(spark, d), 0.3)
    return rejected.select("query_id", "id", "reason")


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    """Of all citations of an answer five for relevance and variety."""
    kept, _ = by_threshold(_candidates(spark, d), 0.01)
    return mmr(kept.withColumn("terms", F.array_distinct(terms(F.col("text")))), 5, 0.75, 2)


def title_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For each question the papers whose title shares most terms with it."""
    small = F.array(*(F.lit(w) for w in ("a", "an", "and", "in", "of", "the", "to", "this", "paper")))
    papers = _chunks(spark, d).groupBy("paper").agg(F.min_by("title", "id").alias("title"))
    words = papers.select("paper", F.explode(F.array_except(F.array_distinct(terms(F.col("title"))), small)).alias("term"))
    asked = _questions(spark, d).select("query_id", F.explode(F.array_except(F.array_distinct(terms(F.col("text"))), small)).alias("term"))
    shared = asked.join(words, "term").groupBy("query_id", "paper").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.withColumn("_most", F.max("n_shared").over(W.partitionBy("query_id"))).where("n_shared = _most").drop("_most")


def quota_select(spark: SparkSession, d: str) -> DataFrame:
    """Of all citations of an answer eight, in turn over the papers cited."""
    c = _candidates(spark, d).withColumns({"source": F.col("paper"), "section": F.lit(None).cast("string")})
    return select_by_quota(c, RetrievalPlan("comparison"), 8, 2)


def overview_select(spark: SparkSession, d: str) -> DataFrame:
    """For each paper the passages that stand for it."""
    return overview_passages(_chunks(spark, d))


def infer_task(spark: SparkSession, d: str) -> DataFrame:
    labels = latest_by(table(spark, d, "relevance_labels_to_review"), "label_id")
    return labels.groupBy(task_of(F.coalesce("query", F.lit(""))).alias("task")).agg(F.count(F.lit(1)).alias("n"))


def similarity_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    """How like a citation's text is to the chunk it names; unknown chunks have no likeness."""
    cited = latest_by(table(spark, d, "citations").select("citation_id", "chunk_id", "text", "loaded_at"), "citation_id")
    stored = _chunks(spark, d).select(F.col("id").alias("chunk_id"), F.col("text").alias("stored"))
    return cited.join(stored, "chunk_id").select("citation_id", F.round(term_overlap(F.col("text"), F.col("stored")), 6).alias("likeness"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.col("doc_id").cast("string")).alias("paper"), "source", "page", F.coalesce("text", F.lit("")).alias("text"), "title")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every hundredth document that has a vector asks by vector and title; both lists are fused, reranked, thresholded and diversified."""
    docs, v = _corpus(spark, d), _vectors(spark, d)
    asked = docs.where((F.col("id") % EVERY == 0) & F.col("title").isNotNull()).join(v.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    config = RetrievalConfig()
    near = nearest(v.where(F.col("id") % EVERY == 0), v, config.dense_candidates)
    return search(asked, docs, config, dense=near).withColumn("reranker_score", F.round("reranker_score", 6)).drop("text")


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth label's question over the stored chunks, which have no vectors: the same steps with words only."""
    return search(_questions(spark, d).select("query_id", "text"), _searched_chunks(spark, d), RetrievalConfig()).withColumn("reranker_score", F.round("reranker_score", 6)).drop("text")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, term_doc_freq, bm25_topk, bm25_scoped, dense_topk, dense_scoped, rrf_hybrid, rrf_weighted_variants, rerank_reserve, rerank_pairs,
        threshold_and_paper_cap, rejected_candidates, mmr_select, title_overlap, quota_select, overview_select, infer_task, similarity_to_chunk, hybrid_search, lexical_search,
    )
}


# --- SQL -----------------------------------------------------------------------------------------


def latest_sql(name: str, key: str, columns: str = "*") -> str:
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST) AS _rn FROM {name} WHERE {key} IS NOT NULL) WHERE _rn = 1)"


def _family_sql(t: str) -> str:
    return (
        rf"(CASE WHEN NOT regexp_full_match({t}, '\p{{L}}{{4,}}') THEN {t} ELSE regexp_replace(CASE WHEN suffix({t}, 'ies') AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' "
        rf"WHEN suffix({t}, 'sses') THEN left({t}, length({t}) - 2) WHEN suffix({t}, 's') AND NOT regexp_matches({t}, '(ss|us|is)$') THEN left({t}, length({t}) - 1) ELSE {t} END, '(ution|uting|uted)$', 'ute') END)"
    )


def terms_sql(x: str) -> str:
    return (
        rf"flatten(list_transform(regexp_extract_all(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.+#/-]*'), "
        rf"lambda t: list_concat([{_family_sql('t')}], list_transform(list_filter(string_split_regex(t, '[.+#/-]+'), lambda p: p <> t), lambda p: {_family_sql('p')}))))"
    )


def jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


_CHUNK_CTE = f"""chunks AS (SELECT chunk_id AS id, source, page, coalesce(title, '') AS title, coalesce(text, '') AS text,
  coalesce(nullif(document_id, ''), nullif(file_hash, ''), nullif(source, ''), chunk_id) AS paper FROM {latest_sql("sync_chunks", "chunk_id")})"""
_QUESTION_CTE = f"""asked AS (SELECT label_id AS query_id, query AS text, source FROM {latest_sql("relevance_labels_to_review", "label_id")} WHERE label_id % {EVERY} = 0 AND query IS NOT NULL)"""

_EVERY_QUESTION_CTE = f"""asked AS (SELECT label_id AS query_id, query AS text FROM {latest_sql("relevance_labels_to_review", "label_id")} WHERE query IS NOT NULL)"""


def _bm25_cte(questions: str, corpus: str) -> str:
    return f"""
tokens AS (SELECT id, {terms_sql("text")} AS t FROM {corpus}),
corpus_size AS (SELECT count(*) AS n, avg(len(t)) AS mean_length FROM tokens),
posted AS (SELECT id, term, len AS length, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tokens) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posted, corpus_size GROUP BY term, n),
weighted AS (SELECT query_id, term, qtf, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf
  FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms_sql("text")}) AS term FROM {questions}) GROUP BY ALL) JOIN raw USING (term)),
scored AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))), 9) AS bm25_score
  FROM posted JOIN weighted USING (term), corpus_size GROUP BY ALL)"""


def _nearest_sql(queries: str, condition: str = "true", most: int = TOP) -> str:
    return f"""SELECT query_id, id, distance, -distance AS dense_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 9) AS distance
  FROM {queries} q, embeddings v WHERE {condition}) QUALIFY rank <= {most}"""


_EVERY_VECTOR = f"(SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0)"
_LISTS_CTE = f"""
docs AS (SELECT doc_id AS id, coalesce(text, '') AS text, title FROM documents),
wanted AS (SELECT id AS query_id, title AS text FROM docs WHERE id % {EVERY} = 0 AND title IS NOT NULL AND id IN (SELECT vec_id FROM embeddings)),
{_bm25_cte("wanted", "docs")},
lists AS (
  SELECT query_id, 0 AS list_no, id, rank, distance, NULL::DOUBLE AS bm25_score FROM ({_nearest_sql("(SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM wanted))")})
  UNION ALL SELECT query_id, 1, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id) AS INTEGER) AS rank, NULL, bm25_score FROM scored QUALIFY rank <= {TOP})"""


def _fused_sql(weight: str = "1.0") -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS INTEGER) AS rank FROM (
  SELECT query_id, id, round(sum({weight} / (60 + rank)), 12) AS rrf_score, min(distance) AS distance, max(bm25_score) AS bm25_score FROM lists GROUP BY query_id, id)"""


_CANDIDATES = f"""
c AS (SELECT *, map_extract_value(scores, 'reranker_score') AS s, coalesce(map_extract_value(scores, 'rrf_score'), 0.0) AS r FROM {latest_sql("citations", "citation_id")} WHERE answer_id IS NOT NULL),
ranked AS (SELECT answer_id AS query_id, citation_id AS id, coalesce(document_id, source, '') AS paper, s, row_number() OVER (PARTITION BY answer_id ORDER BY s DESC, r DESC, citation_id) AS rank FROM c WHERE s IS NOT NULL AND isfinite(s))"""


def _mmr_sql(pool: str, k: int, balance: float, cap: int) -> str:
    """Common table expressions pick1 .. pick<k> over a pool (query_id, id, paper, s, t): each step sees the steps before."""
    out = [f"pool AS (SELECT query_id, id, paper, s, t, CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS r FROM {pool} WINDOW w AS (PARTITION BY query_id))", "pick0 AS (SELECT query_id, id, paper, t, 0 AS place FROM pool WHERE false)"]
    for n in range(1, k + 1):
        before = f"pick{n - 1}"
        out.append(f"""pick{n} AS (SELECT * FROM {before} UNION ALL SELECT query_id, id, paper, t, {n} FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY round({balance} * p.r - {1.0 - balance} * coalesce(l.likeness, 0.0), 12) DESC, p.s DESC, p.id) AS rn
  FROM pool p LEFT JOIN (SELECT a.query_id, a.id, max({jaccard_sql("a.t", "b.t")}) AS likeness FROM pool a JOIN {before} b USING (query_id) GROUP BY ALL) l USING (query_id, id)
  WHERE (p.query_id, p.id) NOT IN (SELECT (query_id, id) FROM {before}) AND (SELECT count(*) FROM {before} c WHERE c.query_id = p.query_id AND c.paper = p.paper) < {cap}) WHERE rn = 1)""")
    return ", ".join(out) + f", picked AS (SELECT query_id, id, CAST(place AS INTEGER) AS place FROM pick{k})"


def _search_sql(corpus: str, asked: str, lists: str) -> str:
    """The rest of a search behind the common table expressions of its lists (query_id, list_no, id, rank)."""
    return f"""fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS rrf_score FROM {lists} GROUP BY ALL)),
scored_pairs AS (SELECT query_id, id, rrf_score, {jaccard_sql("q.t", "c.t")} AS s, paper, source, page, c.t AS t FROM fused JOIN (SELECT query_id, list_distinct({terms_sql("text")}) AS t FROM {asked}) q USING (query_id)
  JOIN (SELECT id, paper, source, page, list_distinct({terms_sql("text")}) AS t FROM {corpus}) c USING (id) WHERE rank <= 20),
able AS (SELECT * FROM scored_pairs WHERE s >= 0.01), {_mmr_sql("able", 5, 0.75, 2)}
SELECT query_id, place, id, source, page, rrf_score, round(s, 6) AS reranker_score FROM picked JOIN able USING (query_id, id)"""


_CLAIM = r"(?i)\b(?:we (?:propose|present|introduce|provide|review|survey|identify|discuss|examine|evaluate|conclude)|this (?:paper|article|survey|work) (?:proposes|presents|introduces|provides|reviews|surveys|discusses|examines|evaluates)|our contributions?)\b"
_SMALL = "['a','an','and','in','of','the','to','this','paper']"

SQL = {
    "tokenize_terms": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)",
    "term_doc_freq": f"WITH {_CHUNK_CTE}, u AS (SELECT id, unnest({terms_sql('text')}) AS term FROM chunks) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM u GROUP BY term",
    "bm25_topk": f"WITH {_CHUNK_CTE}, {_EVERY_QUESTION_CTE}, {_bm25_cte('asked', 'chunks')} SELECT query_id, id, bm25_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= {TOP}",
    "bm25_scoped": f"""WITH {_CHUNK_CTE}, {_QUESTION_CTE},
p AS (SELECT source, min(paper) AS scope FROM chunks WHERE source IS NOT NULL GROUP BY source HAVING min(paper) = max(paper)),
within AS (SELECT query_id, text, scope FROM asked JOIN p USING (source)), {_bm25_cte('within', 'chunks')}
SELECT query_id, id, bm25_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id) AS INTEGER) AS rank FROM scored JOIN within USING (query_id) JOIN chunks USING (id) WHERE scope = paper QUALIFY rank <= {TOP}""",
    "dense_topk": _nearest_sql(_EVERY_VECTOR),
    "dense_scoped": _nearest_sql(_EVERY_VECTOR, "q.label = v.label"),
    "rrf_hybrid": f"WITH {_LISTS_CTE} SELECT query_id, id, rrf_score, distance, bm25_score, rank FROM ({_fused_sql()})",
    "rrf_weighted_variants": f"WITH {_LISTS_CTE} SELECT query_id, id, rrf_score, rank FROM ({_fused_sql('CASE WHEN list_no = 0 THEN 1.0 ELSE 0.5 END')})",
    "rerank_reserve": f"""WITH {_LISTS_CTE}, fused AS ({_fused_sql()}),
u AS (SELECT query_id, id, 0 AS turn, rank FROM lists WHERE list_no = 0 AND rank <= 6 UNION ALL SELECT query_id, id, 1, rank FROM fused),
b AS (SELECT query_id, id, min(turn * 1000000 + rank) AS place_at FROM u GROUP BY ALL)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place_at, id) AS INTEGER) AS place FROM b QUALIFY place <= 11""",
    "mmr_select": f"""WITH {_CANDIDATES}, t AS (SELECT query_id, id, paper, s, list_distinct({terms_sql('text')}) AS t FROM ranked JOIN (SELECT citation_id AS id, text FROM {latest_sql('citations', 'citation_id')}) USING (id) WHERE s >= 0.01),
{_mmr_sql('t', 5, 0.75, 2)} SELECT * FROM picked""",
    "hybrid_search": f"""WITH docs AS (SELECT doc_id AS id, coalesce(source, CAST(doc_id AS VARCHAR)) AS paper, source, page, coalesce(text, '') AS text, title FROM documents),
wanted AS (SELECT id AS query_id, title AS text FROM docs WHERE id % {EVERY} = 0 AND title IS NOT NULL AND id IN (SELECT vec_id FROM embeddings)), {_bm25_cte('wanted', 'docs')},
lists AS (SELECT query_id, 0 AS list_no, id, rank FROM ({_nearest_sql('(SELECT * FROM embeddings WHERE vec_id IN (SELECT query_id FROM wanted))', most=20)})
  UNION ALL SELECT query_id, 1, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20),
{_search_sql('docs', 'wanted', 'lists')}""",
    "lexical_search": f"""WITH {_CHUNK_CTE}, {_QUESTION_CTE}, guarded AS (SELECT query_id, text FROM asked WHERE NOT regexp_matches(text, '(?i)\\bthis\\s+(paper|article|study|survey)\\b')), {_bm25_cte('guarded', 'chunks')},
lists AS (SELECT query_id, 1 AS list_no, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20),
{_search_sql('chunks', 'guarded', 'lists')}""",
    "rerank_pairs": f"SELECT label_id, round({jaccard_sql('a', 'b')}, 6) AS reranker_score FROM (SELECT label_id, list_distinct({terms_sql('query')}) AS a, list_distinct({terms_sql('passage')}) AS b FROM {latest_sql('relevance_labels_to_review', 'label_id')})",
    "threshold_and_paper_cap": f"""WITH {_CANDIDATES},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper ORDER BY rank) AS n FROM ranked WHERE s >= 0.3)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS final_rank FROM k WHERE n <= 2 QUALIFY final_rank <= 5""",
    "rejected_candidates": f"WITH {_CANDIDATES} SELECT query_id, id, 'below_threshold' AS reason FROM ranked WHERE s < 0.3",
    "title_overlap": f"""WITH {_CHUNK_CTE}, {_QUESTION_CTE},
w AS (SELECT paper, unnest(list_filter(list_distinct({terms_sql('title')}), lambda x: NOT list_contains({_SMALL}, x))) AS term FROM (SELECT paper, arg_min(title, id) AS title FROM chunks GROUP BY paper)),
q AS (SELECT query_id, unnest(list_filter(list_distinct({terms_sql('text')}), lambda x: NOT list_contains({_SMALL}, x))) AS term FROM asked)
SELECT * FROM (SELECT query_id, paper, count(*) AS n_shared FROM q JOIN w USING (term) GROUP BY ALL) QUALIFY n_shared = max(n_shared) OVER (PARTITION BY query_id)""",
    "quota_select": f"""WITH {_CANDIDATES}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, paper) AS turn FROM (SELECT query_id, paper, min(rank) AS best FROM ranked GROUP BY ALL)),
t AS (SELECT query_id, id, rank, turn, row_number() OVER (PARTITION BY query_id, paper ORDER BY rank) AS nth FROM ranked JOIN p USING (query_id, paper))
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY nth, turn) AS INTEGER) AS place FROM t QUALIFY place <= 8""",
    "overview_select": rf"""WITH {_CHUNK_CTE}, c AS (SELECT ch.*, s.chunk_index, coalesce(s.section, 'Untitled section') AS section, min(ch.page) OVER (PARTITION BY paper) AS first FROM chunks ch JOIN {latest_sql("sync_chunks", "chunk_id")} s ON s.chunk_id = ch.id WHERE ch.page IS NOT NULL),
said AS (SELECT *, len(regexp_extract_all(text, '{_CLAIM}')) AS n_said, length(text) - length(replace(text, '@', '')) AS n_at FROM c),
o AS (SELECT paper, id, row_number() OVER (PARTITION BY paper ORDER BY n_said DESC, n_at, page, chunk_index NULLS FIRST, id) AS n FROM said WHERE page = first AND length(text) >= 120 AND n_said > 0),
h AS (SELECT paper, id, place, row_number() OVER (PARTITION BY paper, place ORDER BY page, chunk_index NULLS FIRST, id) AS n FROM c, (VALUES (2, 'abstract'), (3, 'contribution'), (4, 'conclusion'), (5, 'introduction')) AS v(place, name)
  WHERE length(text) >= 120 AND contains(lower(regexp_replace(section, '[*_`#]', '', 'g')), name)),
f AS (SELECT paper, id, CASE WHEN n = 1 THEN 1 ELSE 6 END AS place FROM o WHERE n <= 2 UNION ALL SELECT paper, id, place FROM h WHERE n = 1),
l AS (SELECT paper, id, row_number() OVER (PARTITION BY paper ORDER BY page, chunk_index NULLS FIRST, id) AS n FROM c WHERE regexp_matches(text, '(?i)\bdimensions?\b[^:.]{{0,120}}:\s*[^.]{{15,}}'))
SELECT paper, min(place) AS place, id, 'overview' AS reason FROM f GROUP BY paper, id UNION ALL SELECT paper, 0, id, 'direct_list' FROM l WHERE n = 1""".replace("{_CLAIM}", _CLAIM),
    "infer_task": f"""SELECT CASE WHEN regexp_matches(q, '(?i)\\b(conflict|contradict|disagree)') THEN 'conflict' WHEN regexp_matches(q, '(?i)\\b(compare|comparison|differ)') THEN 'comparison'
  WHEN regexp_matches(q, '(?i)\\b(summarize|summarise|summary|overview)\\b') THEN 'summary' ELSE 'focused' END AS task, count(*) AS n FROM (SELECT coalesce(query, '') AS q FROM {latest_sql('relevance_labels_to_review', 'label_id')}) GROUP BY ALL""",
    "similarity_to_chunk": f"""SELECT citation_id, round({jaccard_sql('a', 'b')}, 6) AS likeness FROM (
  SELECT citation_id, list_distinct({terms_sql('c.text')}) AS a, list_distinct({terms_sql('s.text')}) AS b FROM {latest_sql('citations', 'citation_id')} c JOIN {latest_sql('sync_chunks', 'chunk_id')} s USING (chunk_id))""",
}
