"""Pages, synchronisation, context, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.display import plain_text, without_bibliography
from marginalia.operators.context import blocks, candidate_spans
from marginalia.operators.chunks import chunk_position, latest_by, stored_chunks
from marginalia.operators.evaluation import dimension_coverage, generation_metrics, kinds_per_split, label_problems, leaked_queries, locator_hits, locator_metrics, paper_coverage, retrieval_metrics, threshold_metrics
from marginalia.operators.evidence import claims, context_blocks, coverage_warnings, number_evidence, reference, validate
from marginalia.operators.expand import contained, merge_intervals, neighbours, number_paragraphs
from marginalia.operators.pages import carry_sections, guess_title, is_repeated, margin_counts, paragraph_rows, passage_rows, sentence_rows, strip_margins
from marginalia.operators.rerank import term_overlap
from marginalia.operators.snapshots import hex_digest, path_set
from marginalia.operators.sync import by_content, check_deletions, committed, obsolete, plan_sync, sync_counts
from marginalia.operators.terminology import definitions, terminology
from marginalia.plans.search_queries import jaccard_sql, latest_sql, terms_sql
from marginalia.plans.tables import table

THRESHOLDS = [0.0, 0.02, 0.05, 0.1, 0.2, 0.5]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(table(spark, d, "sync_pages"), "page_id")


def _book_pages(spark: SparkSession, d: str) -> DataFrame:
    """One text a document and page: all page rows of that number, in the order of their ids."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return _pages(spark, d).where("document_id IS NOT NULL AND page IS NOT NULL").groupBy("document_id", "page").agg(joined.alias("text"))


def margin_signatures(spark: SparkSession, d: str) -> DataFrame:
    return margin_counts(_book_pages(spark, d)).where(is_repeated()).select("document_id", "place", "signature", "n_pages")


def strip_page_margins(spark: SparkSession, d: str) -> DataFrame:
    return strip_margins(_book_pages(spark, d)).select("document_id", "page", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def title_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", guess_title(F.col("text"), F.regexp_replace(F.coalesce("source", F.lit("")), r"^.*/|\.[^./]*$", "")).alias("title_guess"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    return paragraph_rows(pages, "page_id").join(pages.select("page_id", "document_id", "page"), "page_id").where("document_id IS NOT NULL")


def section_carry(spark: SparkSession, d: str) -> DataFrame:
    return carry_sections(_paragraphs(spark, d), order=("page", "page_id", "paragraph")).select("page_id", "paragraph", "start", "end", "section", "section_id")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return sentence_rows(table(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.col("end") - F.col("start")).alias("longest"))


def page_passages(spark: SparkSession, d: str) -> DataFrame:
    return passage_rows(_pages(spark, d), "page_id", 300, 50)


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries, of each record the row loaded last, with the number of the delivery before."""
    t = table(spark, d, "sync_snapshots").where("snapshot_no IS NOT NULL AND trim(document_id) <> ''").withColumn("_key", F.struct("snapshot_no", "document_id"))
    numbers = table(spark, d, "sync_snapshots").where("snapshot_no IS NOT NULL").select("snapshot_no").distinct()
    numbers = numbers.withColumn("next_no", F.lead("snapshot_no").over(W.orderBy("snapshot_no")))  # a row a delivery
    return latest_by(t, "_key").join(F.broadcast(numbers), "snapshot_no")


def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to do at each delivery, given the one before."""
    rows = _deliveries(spark, d).select("snapshot_no", "next_no", F.nullif(hex_digest(F.col("file_hash")), F.lit("")).alias("digest"), F.explode(path_set(F.col("source_paths"))).alias("path"))
    first = rows.agg(F.min("snapshot_no").alias("_first"))
    now = rows.join(F.broadcast(first), F.col("snapshot_no") > F.col("_first")).drop("_first", "next_no")
    then = rows.where("next_no IS NOT NULL").select(F.col("next_no").alias("snapshot_no"), "digest", "path")
    return plan_sync(now, by_content(then, ("snapshot_no",)), ("snapshot_no",)).drop("paths", "successor")


def sync_plan_counts(spark: SparkSession, d: str) -> DataFrame:
    plan = sync_plan(spark, d)
    check_deletions(plan, 0.9)
    return sync_counts(plan, ("snapshot_no",))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    """Owner rows of the chunks whose document is in the last delivery as indexed or stale."""
    last = table(spark, d, "sync_snapshots")
    last = last.join(F.broadcast(last.agg(F.max("snapshot_no").alias("snapshot_no"))), "snapshot_no").where(F.col("status").isin("indexed", "stale") & F.col("document_id").isNotNull())
    docs = last.groupBy("document_id").agg(F.max(F.to_json(path_set(F.col("source_paths")))).alias("_p")).select("document_id", F.from_json("_p", "array<string>").alias("paths"))
    ids = stored_chunks(table(spark, d, "sync_chunks")).select(F.col("id").alias("chunk_id"), "document_id")
    return ids.join(docs, "document_id").withColumn("document_version", F.lit(None).cast("string"))


def committed_view(spark: SparkSession, d: str) -> DataFrame:
    chunks = stored_chunks(table(spark, d, "sync_chunks")).withColumn("document_version", F.lit(None).cast("string"))
    return committed(chunks, _owners(spark, d)).select("id", "document_id", "source")


def obsolete_chunks(spark: SparkSession, d: str) -> DataFrame:
    return obsolete(stored_chunks(table(spark, d, "sync_chunks")), _owners(spark, d))


def chunk_positions(spark: SparkSession, d: str) -> DataFrame:
    p = chunk_position(F.col("id"), F.col("page"), F.col("chunk_index"))
    return stored_chunks(table(spark, d, "sync_chunks")).select("id", p["page"].alias("at_page"), p["index"].alias("at_index"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    c = stored_chunks(table(spark, d, "sync_chunks")).where("document_id IS NOT NULL AND page IS NOT NULL")
    return number_paragraphs(c, ["document_id"], ["page", F.asc_nulls_first("chunk_index"), "id"])


def _cited_chunks(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(table(spark, d, "citations").select("citation_id", "chunk_id", "loaded_at"), "citation_id").select(F.col("chunk_id").alias("id")).where("id IS NOT NULL").distinct()


def neighbour_band(spark: SparkSession, d: str) -> DataFrame:
    """For every cited chunk the chunks next to it in its document."""
    placed = _placed(spark, d)
    anchors = placed.join(_cited_chunks(spark, d), "id", "left_semi")
    return neighbours(anchors.select("document_id", "id", "position"), placed.select("document_id", "position", "id"), ["document_id"], 1).select("anchor_id", "id", "distance")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).where("character_start IS NOT NULL AND character_end IS NOT NULL").select("document_id", "page", "id", F.col("character_start").alias("start"), F.col("character_end").alias("end"))


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(_spans(spark, d), ["document_id", "page"]).select("document_id", "page", "block", "start", "end", F.size("ids").alias("n_ids"))


def span_containment(spark: SparkSession, d: str) -> DataFrame:
    """In which merged block of cited chunks each stored chunk lies."""
    spans = _spans(spark, d)
    cited = spans.join(_cited_chunks(spark, d), "id", "left_semi")
    return contained(spans, merge_intervals(cited, ["document_id", "page"]), ["document_id", "page"]).select("id", "block")


def expanded_context(spark: SparkSession, d: str) -> DataFrame:
    """Blocks around the chunks that each answer cites: with the next chunks of their section, joined over gaps of up to two characters."""
    stored = stored_chunks(table(spark, d, "sync_chunks")).where("document_id IS NOT NULL AND page IS NOT NULL AND character_start IS NOT NULL AND character_end IS NOT NULL")
    units = stored.select("id", "document_id", "page", F.col("character_start").alias("start"), F.col("character_end").alias("end"), "section_id")
    c = latest_by(table(spark, d, "citations").select("citation_id", "answer_id", "chunk_id", "loaded_at"), "citation_id").where("answer_id IS NOT NULL AND chunk_id IS NOT NULL")
    first = c.groupBy(F.col("answer_id").alias("query_id"), F.col("chunk_id").alias("id")).agg(F.min("citation_id").alias("rank"))
    anchors = first.join(units, "id")
    joins = (F.col("start") - F.col("_reach") <= 2) & F.col("section_id").eqNullSafe(F.col("_carried"))
    return blocks(anchors, candidate_spans(anchors, units, 1), joins).select(F.col("query_id").alias("answer_id"), "block_rank", "document_id", "page", "start", "end", "n_anchors", "kind", F.array_min("ranks").alias("best_anchor"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    c = latest_by(table(spark, d, "citations").select("citation_id", "answer_id", "chunk_id", "source", "page", "text", "loaded_at"), "citation_id").where("answer_id IS NOT NULL")
    return number_evidence(c.withColumnRenamed("chunk_id", "id"), "answer_id", [F.asc("citation_id")])


def evidence_dedupe_ids(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("answer_id", "citation_id", "evidence_id")


def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    c = context_blocks(_evidence(spark, d), "answer_id")
    return c.select("answer_id", F.octet_length("context").alias("n_bytes"), F.md5("context").alias("digest"))


def evidence_references(spark: SparkSession, d: str) -> DataFrame:
    c = stored_chunks(table(spark, d, "sync_chunks"))
    return c.select("id", reference(F.col("title"), F.col("source"), F.col("page")).alias("reference"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer text of each answer: its shown citations one behind the other, each with the marker it was shown with."""
    c = latest_by(table(spark, d, "citations").select("citation_id", "answer_id", "evidence_id", "text", "loaded_at"), "citation_id").where("answer_id IS NOT NULL")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[.!?\s]+$", "")
    part = F.concat(said, F.lit(" ["), F.coalesce("evidence_id", F.lit("E?")), F.lit("]."))
    return c.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


def extract_claims(spark: SparkSession, d: str) -> DataFrame:
    return claims(_answers(spark, d), "answer_id").select("answer_id", "claim_id", "claim", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def validate_citations(spark: SparkSession, d: str) -> DataFrame:
    v = validate(_answers(spark, d), _evidence(spark, d).select("answer_id", "evidence_id"), "answer_id")
    return v.select("answer_id", F.size("cited").alias("n_cited"), F.size("unknown").alias("n_unknown"), F.size("repeated").alias("n_repeated"), F.size("malformed").alias("n_malformed"), "valid")


def uncited_statements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(coverage_warnings(F.col("text"))).alias("n_warnings"))


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every label is a case: its source and page are expected if it's judged relevant; what was retrieved are the citations of the answer with its number."""
    labels = latest_by(table(spark, d, "relevance_labels_to_review"), "label_id")
    relevant = F.coalesce(F.col("relevant"), F.lit(False)) & F.col("source").isNotNull()
    cases = labels.select(F.col("label_id").alias("case_id"), F.when(relevant, "answered").otherwise("abstained").alias("expected"), relevant.cast("int").alias("n_expected"))
    nothing = F.lit(None).cast("string")
    expected = labels.where(relevant).select(F.col("label_id").alias("case_id"), "source", "page", nothing.alias("id"), nothing.alias("text_contains"))
    c = latest_by(table(spark, d, "citations").select("citation_id", "answer_id", "source", "page", "text", "loaded_at"), "citation_id").where("answer_id IS NOT NULL")
    hits = c.select(F.col("answer_id").alias("case_id"), F.row_number().over(W.partitionBy("answer_id").orderBy("citation_id")).alias("rank"), F.col("citation_id").cast("string").alias("id"), "source", "page", "text")
    return cases, expected, hits


def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    cases, expected, hits = _cases(spark, d)
    return retrieval_metrics(cases, locator_hits(hits, expected))


def eval_paper_coverage(spark: SparkSession, d: str) -> DataFrame:
    _, expected, hits = _cases(spark, d)
    return paper_coverage(expected, locator_hits(hits, expected))


def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    labels = latest_by(table(spark, d, "relevance_labels_to_review"), "label_id")
    return threshold_metrics(labels.select("relevant", term_overlap(F.col("query"), F.col("passage")).alias("score")), THRESHOLDS)


def label_checks(spark: SparkSession, d: str) -> DataFrame:
    return label_problems(latest_by(table(spark, d, "relevance_labels_to_review"), "label_id"))


def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    labels = latest_by(table(spark, d, "relevance_labels_to_review"), "label_id")
    return leaked_queries(labels.withColumn("split", F.regexp_replace(F.lower("split"), "[^a-z]", "")))


def display_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(plain_text(F.col("text"))).alias("digest"))


def bibliography_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(without_bibliography(F.col("text"))).alias("n_kept"))


def acronym_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Acronyms with one spelled-out form in all documents."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.col("doc_id").cast("string")).alias("paper"), "text", "title")
    return terminology(definitions(docs))


def locator_scores(spark: SparkSession, d: str) -> DataFrame:
    """What the citations of each answer find of the passages that labels expect."""
    _, expected, hits = _cases(spark, d)
    return locator_metrics(expected, hits)


def coverage_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Expected locators by source and by the label's kind as dimension."""
    labels = latest_by(table(spark, d, "relevance_labels_to_review"), "label_id")
    _, expected, hits = _cases(spark, d)
    return dimension_coverage(expected.join(labels.select(F.col("label_id").alias("case_id"), F.col("kind").alias("dimension")), "case_id"), hits)


def generation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every label as a case, answered where its answer's citations hold."""
    cases, expected, _ = _cases(spark, d)
    checked = validate(_answers(spark, d), _evidence(spark, d).select("answer_id", "evidence_id"), "answer_id").select(F.col("answer_id").alias("case_id"), F.col("valid").alias("references_valid"))
    none = F.lit(None)
    c = cases.join(checked, "case_id", "left").withColumn("actual", F.when(F.col("references_valid"), "answered").when(~F.col("references_valid"), "validation_failed").otherwise("abstained"))
    c = c.withColumns({"support": F.when(F.col("references_valid"), "passed"), "model_calls": F.lit(2), "recovery_rounds": none.cast("int"), "recovery_success": none.cast("boolean")})
    cited = _evidence(spark, d).select(F.col("answer_id").alias("case_id"), "source", "page").join(c.where("actual = 'answered'").select("case_id"), "case_id", "left_semi")
    return generation_metrics(c, cited, expected)


def calibration_checks(spark: SparkSession, d: str) -> DataFrame:
    labels = latest_by(table(spark, d, "relevance_labels_to_review"), "label_id")
    return kinds_per_split(labels.withColumn("split", F.regexp_replace(F.lower("split"), "[^a-z]", "")))


QUERIES = {
    f.__name__: f
    for f in (
        margin_signatures, strip_page_margins, title_guess, section_carry, sentence_counts, page_passages, content_digest, sync_plan, sync_plan_counts, committed_view, obsolete_chunks, chunk_positions,
        neighbour_band, interval_merge, span_containment, expanded_context, evidence_dedupe_ids, evidence_context, evidence_references, extract_claims, validate_citations, uncited_statements,
        eval_recall_mrr, eval_paper_coverage, threshold_table, label_checks, leakage_check, display_text, bibliography_cut, acronym_definitions, locator_scores, coverage_by_kind, generation_scores, calibration_checks,
    )
}


# --- SQL -----------------------------------------------------------------------------------------

_PAGES = latest_sql("sync_pages", "page_id")
_LABELS = latest_sql("relevance_labels_to_review", "label_id")
_CITED = latest_sql("citations", "citation_id")
_STORED = latest_sql("sync_chunks", "chunk_id")
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _digest_sql(x: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(lower({x}), '^\s*sha-?256\s*[:=]?', ''), '[^0-9a-f]', '', 'g'), '')"


_PATHS = """CASE WHEN source_paths IS NULL OR trim(source_paths) IN ('', 'null') THEN [] ELSE list_sort(list_distinct(from_json(source_paths, '["VARCHAR"]'))) END"""
_PLAN = f"""
numbered AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT snapshot_no FROM sync_snapshots WHERE snapshot_no IS NOT NULL)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, document_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM sync_snapshots WHERE trim(document_id) <> '') WHERE rn = 1),
rows_ AS (SELECT snapshot_no, next_no, before_no, {_digest_sql("file_hash")} AS digest, unnest({_PATHS}) AS path FROM latest JOIN numbered USING (snapshot_no)),
f AS (SELECT snapshot_no, digest, path FROM rows_ WHERE before_no IS NOT NULL AND digest IS NOT NULL),
m AS (SELECT next_no AS snapshot_no, digest, path FROM rows_ WHERE next_no IS NOT NULL AND digest IS NOT NULL),
n AS (SELECT snapshot_no, digest, list_sort(list(DISTINCT path)) AS np FROM f GROUP BY ALL), o AS (SELECT snapshot_no, digest, list_sort(list(DISTINCT path)) AS op FROM m GROUP BY ALL),
plan AS (SELECT snapshot_no, digest, CASE
    WHEN op IS NULL THEN CASE WHEN (snapshot_no, digest) IN (SELECT (f.snapshot_no, f.digest) FROM f JOIN m ON f.snapshot_no = m.snapshot_no AND f.path = m.path) THEN 'modified' ELSE 'added' END
    WHEN np IS NULL THEN CASE WHEN (snapshot_no, digest) IN (SELECT (m.snapshot_no, m.digest) FROM f JOIN m ON f.snapshot_no = m.snapshot_no AND f.path = m.path) THEN 'replaced' ELSE 'deleted' END
    WHEN np = op THEN 'unchanged' WHEN len(np) = 1 AND len(op) = 1 THEN 'renamed' ELSE 'moved' END AS action,
  coalesce(np[1], op[1]) AS primary_path, CAST(greatest(coalesce(len(np), 0) - 1, 0) AS INTEGER) AS n_duplicates FROM n FULL JOIN o USING (snapshot_no, digest))"""
_OWNED = f"""
last AS (SELECT document_id, max(CAST(to_json({_PATHS}) AS VARCHAR)) AS p FROM sync_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM sync_snapshots) AND status IN ('indexed', 'stale') AND document_id IS NOT NULL GROUP BY document_id)"""
_PLACED = f"""
stored AS (SELECT chunk_id AS id, document_id, page, chunk_index, character_start, character_end FROM {_STORED}),
placed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, chunk_index NULLS FIRST, id) AS position FROM stored WHERE document_id IS NOT NULL AND page IS NOT NULL),
cited AS (SELECT DISTINCT chunk_id AS id FROM {_CITED} WHERE chunk_id IS NOT NULL)"""


def _blocks_sql(spans: str) -> str:
    return f"""SELECT document_id, page, block, min(s) AS start, max(e) AS "end", len(list(DISTINCT id)) AS n_ids FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS block FROM (
    SELECT *, max(e) OVER (PARTITION BY document_id, page ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
      SELECT document_id, page, id, character_start AS s, character_end AS e FROM {spans} WHERE character_start IS NOT NULL AND character_end IS NOT NULL))) GROUP BY document_id, page, block"""


_EVIDENCE = f"""
evidence AS (SELECT answer_id, citation_id, chunk_id, source, page, text, 'E' || row_number() OVER (PARTITION BY answer_id ORDER BY citation_id) AS evidence_id FROM (
  SELECT *, row_number() OVER (PARTITION BY answer_id, chunk_id IS NULL, chunk_id, CASE WHEN chunk_id IS NULL THEN (text, source, page) END ORDER BY citation_id) AS n FROM {_CITED} WHERE answer_id IS NOT NULL) WHERE n = 1)"""
_SP = r"[ \t\n\x{0b}\f\r]"
# A link's bracket and what follows a citation are marked, so that neither needs a look around.
_NO_LINK = rf"regexp_replace(regexp_replace(%s, '\]({_SP}*\()', chr(2) || '\1', 'g'), '\]', ']' || chr(1), 'g')"
_CITE = r"(^|[^\p{L}\p{N}_])\[(E\p{Nd}+)\]"


def _cited_sql(x: str) -> str:
    return f"regexp_extract_all({_NO_LINK % x}, '{_CITE}', 2)"


def _segments_sql(x: str) -> str:
    return rf"string_split(regexp_replace(regexp_replace({x}, '([.!?]){_SP}+', '\1' || chr(3), 'g'), '\n+', chr(3), 'g'), chr(3))"


_ANSWERED = rf"""
shown AS (SELECT answer_id, citation_id, regexp_replace(coalesce(text, ''), '[.!?\s\x{{0b}}]+$', '') || ' [' || coalesce(evidence_id, 'E?') || '].' AS p FROM {_CITED} WHERE answer_id IS NOT NULL),
answers AS (SELECT answer_id, string_agg(p, chr(10) ORDER BY citation_id, p) AS text FROM shown GROUP BY answer_id)"""
_CLAIM = rf"regexp_replace(replace(regexp_replace({_NO_LINK % 'seg'}, '{_CITE}', '\1', 'g'), chr(1), ''), chr(2), ']', 'g')"
_CLAIM = rf"regexp_replace(regexp_replace({_CLAIM}, '^{_SP}*(?:#{{1,6}}|[-+*>]|[0-9]+[.)]){_SP}+', ''), '\*\*|__|~~|`', '', 'g')"
_CLAIM = rf"trim(regexp_replace(regexp_replace({_CLAIM}, '{_SP}+([.,;:!?])', '\1', 'g'), '{_WS}+', ' ', 'g'))"
_FACT = r"(?i)\b(is|are|was|were|has|have|had|shows?|found|demonstrates?|reported|increased|decreased|improved|reduces?|reduced|uses?|used|includes?)\b"
_CASES = f"""
cases AS (SELECT label_id AS case_id, coalesce(relevant, false) AND source IS NOT NULL AS wanted, source, page FROM {_LABELS}),
hits AS (SELECT answer_id AS case_id, row_number() OVER (PARTITION BY answer_id ORDER BY citation_id) AS rank, source, page FROM {_CITED} WHERE answer_id IS NOT NULL),
marked AS (SELECT h.*, coalesce(c.wanted AND h.source = c.source AND h.page IS NOT DISTINCT FROM c.page, false) AS matched FROM hits h LEFT JOIN cases c USING (case_id)),
per AS (SELECT case_id, count(*) AS n_hits, count(*) FILTER (matched) AS n_matched, min(rank) FILTER (matched) AS first FROM marked GROUP BY case_id),
joined AS (SELECT c.*, coalesce(n_hits, 0) AS n_hits, coalesce(n_matched, 0) AS n_matched, first FROM cases c LEFT JOIN per USING (case_id))"""

SQL = {
    "title_guess": rf"""
WITH l AS (SELECT doc_id, source, list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) AS ls FROM documents),
t AS (SELECT doc_id, list_filter(ls, lambda x: regexp_matches(x, '^#\s+\S'))[1] AS h, list_filter(ls, lambda x: length(x) > 15 AND NOT (upper(x) = x AND lower(x) <> x))[1] AS u, regexp_replace(coalesce(source, ''), '^.*/|\.[^./]*$', '', 'g') AS stem FROM l)
SELECT doc_id, CASE WHEN h IS NOT NULL THEN {_squeeze_sql("regexp_replace(regexp_replace(regexp_replace(h, '^#{BS}s+|{BS}s*#*{BS}s*$', '', 'g'), '<[^>]+>', '', 'g'), '[*_`#]+', '', 'g')").replace("{BS}", chr(92))}
  WHEN u IS NOT NULL THEN {_squeeze_sql("regexp_replace(regexp_replace(u, '<[^>]+>', '', 'g'), '[*_`#]+', '', 'g')")} ELSE stem END AS title_guess FROM t""",
    "content_digest": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "sync_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "sync_plan_counts": f"WITH {_PLAN} SELECT snapshot_no, action, count(*) AS n, CAST(sum(n_duplicates) AS BIGINT) AS n_duplicates FROM plan GROUP BY ALL",
    "committed_view": f"WITH {_OWNED} SELECT chunk_id AS id, document_id, coalesce(from_json(p, '[\"VARCHAR\"]')[1], source) AS source FROM {_STORED} JOIN last USING (document_id)",
    "obsolete_chunks": f"WITH {_OWNED} SELECT chunk_id AS id FROM {_STORED} WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM last)",
    "chunk_positions": rf"""SELECT chunk_id AS id, CASE WHEN page IS NOT NULL AND chunk_index IS NOT NULL THEN page WHEN p = page THEN p END AS at_page, CASE WHEN page IS NOT NULL AND chunk_index IS NOT NULL THEN chunk_index WHEN p = page THEN i END AS at_index FROM (
  SELECT *, TRY_CAST(regexp_extract(chunk_id, '(?i)^[0-9a-f]{{16,64}}-(\d+)-(\d+)(?:-[0-9a-f]{{16}})?$', 1) AS INTEGER) AS p, TRY_CAST(regexp_extract(chunk_id, '(?i)^[0-9a-f]{{16,64}}-(\d+)-(\d+)(?:-[0-9a-f]{{16}})?$', 2) AS INTEGER) AS i FROM {_STORED})""",
    "neighbour_band": f"WITH {_PLACED} SELECT a.id AS anchor_id, b.id AS id, abs(a.position - b.position) AS distance FROM placed a JOIN cited USING (id) JOIN placed b ON a.document_id = b.document_id AND a.position <> b.position AND abs(a.position - b.position) <= 1",
    "interval_merge": f"WITH {_PLACED} {_blocks_sql('placed')}",
    "span_containment": f"""WITH {_PLACED}, blocks AS ({_blocks_sql('(SELECT placed.* FROM placed JOIN cited USING (id))')})
SELECT id, block FROM placed JOIN blocks b USING (document_id, page) WHERE b.start <= character_start AND character_end <= b."end" """,
    "expanded_context": f"""WITH units AS (SELECT chunk_id AS id, document_id, page, character_start AS s, character_end AS e, section_id, row_number() OVER (PARTITION BY document_id ORDER BY page, character_start, character_end, chunk_id) AS position
  FROM {_STORED} WHERE document_id IS NOT NULL AND page IS NOT NULL AND character_start IS NOT NULL AND character_end IS NOT NULL),
anchors AS (SELECT answer_id AS query_id, u.id, min(citation_id) AS rank, u.document_id, u.page, s, e, section_id FROM {_CITED} c JOIN units u ON u.id = c.chunk_id WHERE answer_id IS NOT NULL GROUP BY ALL),
touched AS (SELECT a.query_id, a.rank, a.document_id, a.section_id, min(position) AS low, max(position) AS high FROM anchors a JOIN units u ON u.document_id = a.document_id AND u.page = a.page AND u.s < a.e AND u.e > a.s GROUP BY ALL),
spans AS (SELECT query_id, rank, u.document_id, page, s, e, u.section_id FROM touched t JOIN units u ON u.document_id = t.document_id AND position BETWEEN low - 1 AND high + 1 AND u.section_id IS NOT DISTINCT FROM t.section_id),
al AS (SELECT query_id, rank, document_id, page, s, e, section_id FROM anchors UNION ALL SELECT * FROM spans),
r AS (SELECT *, max(struct_pack(e := e, x := coalesce(section_id, -2147483648))) OVER (PARTITION BY query_id, document_id, page ORDER BY s, e, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM al),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR NOT (s <= reach.e OR (s - reach.e <= 2 AND coalesce(section_id, -2147483648) = reach.x)) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, document_id, page ORDER BY s, e, rank ROWS UNBOUNDED PRECEDING) AS block FROM r),
m AS (SELECT query_id, document_id, page, block, min(s) AS s, max(e) AS e, min(rank) AS best_anchor FROM b GROUP BY ALL),
h AS (SELECT m.*, count(a.id) FILTER (a.s >= m.s AND a.e <= m.e) AS n_anchors, coalesce(bool_or(a.s = m.s AND a.e = m.e), false) AS exact FROM m LEFT JOIN anchors a USING (query_id, document_id, page) GROUP BY ALL)
SELECT query_id AS answer_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_anchor, page, s, document_id) AS INTEGER) AS block_rank, document_id, page, s AS start, e AS "end", n_anchors,
  CASE WHEN n_anchors = 1 AND exact THEN 'anchor' WHEN n_anchors > 0 THEN 'anchor_context' ELSE 'expansion' END AS kind, best_anchor FROM h""",
    "evidence_dedupe_ids": f"WITH {_EVIDENCE} SELECT answer_id, citation_id, evidence_id FROM evidence",
    "evidence_context": f"""WITH {_EVIDENCE}, c AS (SELECT answer_id, string_agg('[' || evidence_id || ']' || chr(10) || 'Source: ' || coalesce(nullif(source, ''), 'Unknown document') || coalesce(chr(10) || 'Page: ' || CAST(page AS VARCHAR), '') || chr(10) || 'Content: ' || coalesce(text, ''),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY CAST(substr(evidence_id, 2) AS INTEGER)) AS context FROM evidence GROUP BY answer_id) SELECT answer_id, CAST(strlen(context) AS INTEGER) AS n_bytes, md5(context) AS digest FROM c""",
    "evidence_references": f"""SELECT chunk_id AS id, label || CASE WHEN coalesce(source, '') <> '' AND source <> label THEN ' (' || source || ')' ELSE '' END || coalesce(', page ' || page, '') AS reference
FROM (SELECT *, coalesce(nullif(title, ''), nullif(source, ''), 'Unknown document') AS label FROM {_STORED})""",
    "extract_claims": rf"""WITH {_ANSWERED}, segs AS (SELECT answer_id, unnest({_segments_sql('text')}) AS seg, generate_subscripts({_segments_sql('text')}, 1) AS pos FROM answers),
c AS (SELECT answer_id, pos, {_cited_sql('seg')} AS ids, {_CLAIM} AS claim FROM segs)
SELECT answer_id, 'C' || row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS claim_id, claim, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS evidence_ids
FROM c WHERE len(ids) > 0 AND regexp_matches(claim, '[\p{{L}}\p{{N}}_]')""",
    "validate_citations": rf"""WITH {_EVIDENCE}, {_ANSWERED}, known AS (SELECT answer_id, list(evidence_id) AS k FROM evidence GROUP BY answer_id),
c AS (SELECT answer_id, text, {_cited_sql('text')} AS cited, coalesce(k, []) AS k, regexp_extract_all(text, '(?i)\[(E\s*[0-9]+[^\]]*)\]', 1) AS likes,
  regexp_extract_all(text, '(?i)(\[[^\]\n,]+,\s*(?:[^\]]+,\s*)?p\.\s*[0-9]+[^\]]*\])', 1) AS legacy FROM answers LEFT JOIN known USING (answer_id)),
v AS (SELECT answer_id, len(cited) AS n_cited, len(list_filter(list_distinct(cited), lambda x: NOT list_contains(k, x))) AS n_unknown, len(list_filter(list_distinct(cited), lambda x: len(list_filter(cited, lambda y: y = x)) > 1)) AS n_repeated,
  len(list_filter(likes, lambda x: NOT regexp_full_match(x, 'E[0-9]+'))) AS n_malformed, len(legacy) AS n_legacy FROM c)
SELECT answer_id, n_cited::INTEGER AS n_cited, n_unknown::INTEGER AS n_unknown, n_repeated::INTEGER AS n_repeated, n_malformed::INTEGER AS n_malformed, n_cited > 0 AND n_unknown + n_malformed + n_legacy = 0 AS valid FROM v""",
    "uncited_statements": rf"""SELECT doc_id, CAST(len(list_filter(list_transform({_segments_sql("coalesce(text, '')")}, lambda s: regexp_replace(s, '^[ \t#>*\-`]+|[ \t#>*\-`]+$', '', 'g')),
  lambda s: s <> '' AND NOT regexp_matches(s, '^[\[|]|:$') AND NOT (regexp_matches(s, '(?i)\b(Evidence|References|Answer|Note|Not covered)\b') AND len(list_filter(string_split_regex(s, '{_WS}+'), lambda w: w <> '')) < 7)
    AND regexp_matches(s, '{_FACT}') AND len({_cited_sql('s')}) = 0)) AS INTEGER) AS n_warnings FROM documents""",
    "margin_signatures": rf"""WITH pages AS (SELECT document_id, page, string_agg(coalesce(text, ''), chr(10) ORDER BY page_id) AS text FROM {_PAGES} WHERE document_id IS NOT NULL AND page IS NOT NULL GROUP BY ALL),
l AS (SELECT document_id, page, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT *, string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)) AS ls FROM pages)),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY line_no) AS from_top, row_number() OVER (PARTITION BY document_id, page ORDER BY line_no DESC) AS from_bottom FROM l WHERE regexp_replace(line, '{_WS}+', '', 'g') <> ''),
p AS (SELECT *, replace(lower({_squeeze_sql("regexp_replace(regexp_replace(line, '<[^>]+>', '', 'g'), '[*_`#]+', '', 'g')")}), 'ß', 'ss') AS plain FROM f WHERE from_top <= 2 OR from_bottom <= 2),
g AS (SELECT *, {_squeeze_sql("regexp_replace(plain, '[{Nd}]+', '#', 'g')").replace("[{Nd}]", "[0-9]")} AS masked FROM p),
s AS (SELECT *, CASE WHEN plain = '' THEN NULL WHEN regexp_full_match(plain, '(?:page\s*)?[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?') THEN '<page-number>' WHEN length(masked) <= 200 AND length(regexp_replace(masked, '[^\p{{L}}]', '', 'g')) >= 4 THEN masked END AS signature FROM g),
c AS (SELECT document_id, place, signature, count(DISTINCT page) AS n_pages FROM (SELECT *, 'top' AS place FROM s WHERE from_top <= 2 UNION ALL SELECT *, 'bottom' FROM s WHERE from_bottom <= 2) WHERE signature IS NOT NULL GROUP BY ALL)
SELECT document_id, place, signature, n_pages FROM c JOIN (SELECT document_id, count(*) AS n_all FROM pages GROUP BY document_id) USING (document_id) WHERE n_pages >= greatest(2, ceil(n_all * 0.3))""",
    "bibliography_cut": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT *, regexp_replace(regexp_replace(text, '(?im)^{_SP}*(?:#{{1,6}}{_SP}*)?(?:\*\*|__)?{_SP}*(?:[0-9]+[.)]?{_SP}*)?(?:references|bibliography|works cited){_SP}*(?:\*\*|__)?{_SP}*:?{_SP}*$(?s:.*)', ''),
  '(?m)^{_SP}*(?:[-*+]{_SP}*)?\[[0-9]{{1,4}}\]{_SP}+\p{{Lu}}(?s:.*)', '') AS before FROM t),
k AS (SELECT doc_id, text, CASE WHEN before <> text THEN before WHEN len(regexp_extract_all(text, '\[[0-9]{{1,4}}\]{_SP}+[A-Z][\p{{L}}\p{{N}}_-]+')) >= 2 THEN regexp_replace(text, '\[[0-9]{{1,4}}\]{_SP}+[A-Z][\p{{L}}\p{{N}}_-]+(?s:.*)', '') ELSE text END AS cut FROM c)
SELECT doc_id, CAST(length(CASE WHEN cut <> text THEN regexp_replace(cut, '(?i){_SP}*(?:retrieved from|doi:){_SP}*!?\[[^\]]+\]\([^)]*\)\.?{_SP}*$', '') ELSE cut END) AS INTEGER) AS n_kept FROM k""",
    "eval_recall_mrr": f"""WITH {_CASES} SELECT count(*) FILTER (wanted) AS retrieval_cases, round(count(*) FILTER (wanted AND n_matched > 0) / nullif(count(*) FILTER (wanted), 0), 4) AS recall,
  round(avg(coalesce(1.0 / first, 0.0)::DOUBLE) FILTER (wanted), 4) AS mrr, round(sum(n_hits - n_matched) FILTER (wanted) / nullif(sum(n_hits) FILTER (wanted), 0), 4) AS unmatched_fraction,
  count(*) FILTER (NOT wanted AND n_hits > 0) AS negative_cases_with_evidence, CAST(coalesce(sum(n_hits) FILTER (NOT wanted), 0) AS BIGINT) AS negative_evidence_blocks FROM joined""",
    "eval_paper_coverage": f"""WITH {_CASES}, g AS (SELECT DISTINCT case_id, source FROM marked WHERE matched)
SELECT source, count(*) AS expected_cases, count(g.case_id) AS hits, round(count(g.case_id) / count(*), 4) AS recall FROM (SELECT DISTINCT case_id, source FROM cases WHERE wanted) c LEFT JOIN g USING (case_id, source) GROUP BY source""",
    "locator_scores": f"""WITH {_CASES}, e AS (SELECT case_id, source, page FROM cases WHERE wanted), m AS (SELECT *, (case_id, source, coalesce(page, -1)) IN (SELECT (case_id, source, coalesce(page, -1)) FROM e) AS ok FROM hits),
best AS (SELECT e.case_id, min(m.rank) FILTER (ok) AS first FROM (SELECT DISTINCT case_id FROM e) e LEFT JOIN m USING (case_id) GROUP BY ALL)
SELECT round(count(*) FILTER (ok) / count(*), 4) AS locator_precision, (SELECT round(count(*) FILTER ((case_id, source, coalesce(page, -1)) IN (SELECT (case_id, source, coalesce(page, -1)) FROM hits)) / count(*), 4) FROM e) AS locator_recall,
  (SELECT round(count(first) / count(*), 4) FROM best) AS page_recall, (SELECT round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 4) FROM best) AS mrr FROM m""",
    "coverage_by_kind": f"""WITH {_CASES}, k AS (SELECT label_id AS case_id, kind AS dimension FROM {_LABELS}), e AS (SELECT DISTINCT case_id, source, page, dimension FROM cases JOIN k USING (case_id) WHERE wanted AND dimension IS NOT NULL)
SELECT source, dimension, count(*) AS expected, count(*) FILTER ((case_id, source, coalesce(page, -1)) IN (SELECT (case_id, source, coalesce(page, -1)) FROM hits)) AS retrieved,
  round(count(*) FILTER ((case_id, source, coalesce(page, -1)) IN (SELECT (case_id, source, coalesce(page, -1)) FROM hits)) / count(*), 4) AS recall FROM e GROUP BY ALL""",
    "calibration_checks": f"""WITH h AS (SELECT DISTINCT regexp_replace(lower(split), '[^a-z]', '', 'g') AS split, kind FROM {_LABELS} WHERE split IS NOT NULL),
w AS (SELECT DISTINCT split, unnest(['relevant', 'topical_negative', 'out_of_corpus']) AS kind FROM h WHERE kind IS NOT NULL) SELECT * FROM w EXCEPT SELECT split, kind FROM h WHERE kind IS NOT NULL""",
    "threshold_table": f"""WITH s AS (SELECT relevant, {jaccard_sql('a', 'b')} AS score FROM (SELECT relevant, list_distinct({terms_sql('query')}) AS a, list_distinct({terms_sql('passage')}) AS b FROM {_LABELS}) WHERE relevant IS NOT NULL),
m AS (SELECT threshold, count(*) FILTER (score >= threshold AND relevant) AS tp, count(*) FILTER (score >= threshold AND NOT relevant) AS fp, count(*) FILTER (score < threshold AND relevant) AS fn, count(*) FILTER (score < threshold AND NOT relevant) AS tn
  FROM s, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold) GROUP BY threshold)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fn / nullif(tp + fn, 0), 6) AS false_rejection_rate, round(fp / nullif(fp + tn, 0), 6) AS false_acceptance_rate FROM m""",
    "label_checks": f"""WITH l AS (SELECT * FROM {_LABELS})
SELECT 'missing_field' AS problem, count(*) FILTER (trim(coalesce(annotator, '')) = '' OR trim(coalesce(query, '')) = '' OR trim(coalesce(passage, '')) = '' OR relevant IS NULL OR kind IS NULL OR kind NOT IN ('relevant', 'topical_negative', 'out_of_corpus')) AS n FROM l
UNION ALL SELECT 'label_and_kind_disagree', count(*) FILTER (coalesce(relevant <> (kind = 'relevant'), false)) FROM l
UNION ALL SELECT 'duplicate_label', count(*) FROM (SELECT query, passage FROM l WHERE query IS NOT NULL AND passage IS NOT NULL GROUP BY ALL HAVING count(*) > 1)""",
    "leakage_check": f"""SELECT question, count(DISTINCT split) AS n_splits FROM (SELECT regexp_replace(lower(split), '[^a-z]', '', 'g') AS split, {_squeeze_sql("lower(query)")} AS question FROM {_LABELS} WHERE split IS NOT NULL) WHERE question <> '' GROUP BY question HAVING count(DISTINCT split) > 1""",
}

SQL["generation_scores"] = f"""WITH {_CASES}, v AS (SELECT * FROM ({SQL["validate_citations"]})),
g AS (SELECT case_id, wanted, c.source, c.page, CASE WHEN valid THEN 'answered' WHEN NOT valid THEN 'validation_failed' ELSE 'abstained' END AS actual FROM cases c LEFT JOIN v ON v.answer_id = case_id),
e AS (WITH {_EVIDENCE} SELECT * FROM evidence),
cited AS (SELECT coalesce(g.wanted AND g.source = e.source AND g.page IS NOT DISTINCT FROM e.page, false) AS ok FROM e JOIN g ON g.case_id = e.answer_id WHERE actual = 'answered')
SELECT count(*) AS generation_cases, 0::BIGINT AS generation_failures, round(count(*) FILTER (actual = CASE WHEN wanted THEN 'answered' ELSE 'abstained' END) / count(*), 4) AS outcome_accuracy,
  round(count(*) FILTER (wanted AND actual = 'answered') / nullif(count(*) FILTER (wanted), 0), 4) AS supported_answer_rate, count(*) FILTER (wanted AND actual = 'abstained') AS false_abstentions, count(*) FILTER (NOT wanted AND actual = 'answered') AS false_answers,
  round(count(*) FILTER (NOT wanted AND actual = 'abstained') / nullif(count(*) FILTER (NOT wanted), 0), 4) AS abstention_correctness, round(count(*) FILTER (actual = 'answered') / nullif(count(*) FILTER (wanted), 0), 4) AS citation_valid_answer_rate,
  2 * count(*) AS model_calls, 0::BIGINT AS recovery_attempts, NULL::DOUBLE AS recovery_success_rate, (SELECT round(count(*) FILTER (ok) / nullif(count(*), 0), 4) FROM cited) AS citation_locator_precision FROM g"""
