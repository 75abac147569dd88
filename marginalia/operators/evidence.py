"""Evidence and the citations in an answer, as relations and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.display import excerpt

# How citations are written (as asked for, nearly so, in the old style), and words that make a sentence factual or a label.
_CITED_UNICODE = r"(?<![\p{L}\p{N}_])\[(E\p{Nd}+)\](?!\s*\()"
_LIKE = r"(?i)\[(E\s*\d+[^\]]*)\]"
_LEGACY = r"(?i)(\[[^\]\n,]+,\s*(?:[^\]]+,\s*)?p\.\s*\d+[^\]]*\])"
_FACTUAL = r"(?i)\b(is|are|was|were|has|have|had|shows?|found|demonstrates?|reported|increased|decreased|improved|reduces?|reduced|uses?|used|includes?)\b"
_LABEL = r"(?i)\b(Evidence|References|Answer|Note|Not covered)\b"


def segments(answer: Column) -> Column:
    """Sentences and lines of an answer."""
    return F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?])\s+|\n+")


def cited_ids(text: Column) -> Column:
    """Evidence ids in the order of their citations, with repetitions."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CITED_UNICODE), F.lit(1))


def claim_text(segment: Column) -> Column:
    """A segment without citations, list marks and emphasis."""
    t = F.regexp_replace(segment, _CITED_UNICODE, "")
    t = F.regexp_replace(t, r"^\s*(?:#{1,6}|[-+*>]|\d+[.)])\s+", "")
    t = F.regexp_replace(t, r"\*\*|__|~~|`", "")
    t = F.regexp_replace(t, r"\s+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def claims(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ``claim_id`` C1.., ``claim``, ``evidence_ids``): the segments with citations and any letter or digit."""
    parts = answers.select(key, F.posexplode(segments(F.col(text))).alias("_at", "_segment")).withColumn("evidence_ids", F.array_distinct(cited_ids(F.col("_segment")))).withColumn("claim", claim_text(F.col("_segment")))
    kept = parts.where((F.size("evidence_ids") > 0) & F.col("claim").rlike(r"[\p{L}\p{N}_]"))
    number = F.row_number().over(W.partitionBy(key).orderBy("_at"))
    return kept.withColumn("claim_id", F.concat(F.lit("C"), number)).select(key, "claim_id", "claim", "evidence_ids")


def number_evidence(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Evidence ids E1.. in rank order after dropping repeats (same id; without id the same text, source and page)."""
    same = F.when(F.col("id").isNotNull(), F.struct(F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("int").alias("c"))).otherwise(F.struct(F.coalesce("text", F.lit("")).alias("a"), F.coalesce("source", F.lit("")).alias("b"), F.coalesce("page", F.lit(-1)).alias("c")))
    first = rows.withColumn("_same", same).withColumn("_has", F.col("id").isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(group, "_has", "_same").orderBy(*order))).where("_n = 1")
    return first.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(W.partitionBy(group).orderBy(*order)))).drop("_same", "_has", "_n")


def source_name(title: Column, source: Column) -> Column:
    """``title (source)``; only one of them where the other is unknown or the same."""
    label = F.coalesce(F.nullif(title, F.lit("")), F.nullif(source, F.lit("")), F.lit("Unknown document"))
    return F.when((F.coalesce(source, F.lit("")) != "") & (source != label), F.concat(label, F.lit(" ("), source, F.lit(")"))).otherwise(label)


def reference(title: Column, source: Column, page: Column) -> Column:
    """``title (source), page n`` as far as known."""
    named = source_name(title, source)
    return F.when(page.isNotNull(), F.concat(named, F.lit(", page "), page.cast("string"))).otherwise(named)


def coverage_warnings(answer: Column) -> Column:
    """Sentences that state something without a citation; a heuristic."""
    bare = F.transform(segments(answer), lambda s: F.regexp_replace(s, r"^[ \t#>*\-`]+|[ \t#>*\-`]+$", ""))
    return F.filter(
        bare,
        lambda s: (s != "") & ~s.rlike(r"^[\[|]|:$") & ~(s.rlike(_LABEL) & (F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")) < 7)) & s.rlike(_FACTUAL) & (F.size(cited_ids(s)) == 0),
    )


def validate(answers: DataFrame, evidence: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row an answer: cited, unknown and repeated ids, malformed and old-style citations, and whether its references hold.

    ``evidence`` is (key, evidence_id).  Valid: nothing unknown or malformed and at least one citation; repeated ids don't matter.
    """
    supplied = evidence.groupBy(key).agg(F.collect_set("evidence_id").alias("_known"))
    a = answers.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(supplied, key, "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    cited = cited_ids(F.col("_t"))
    like = F.regexp_extract_all(F.col("_t"), F.lit(_LIKE), F.lit(1))
    a = a.select(
        key, cited.alias("cited"), F.array_except(F.array_distinct(cited), F.col("_known")).alias("unknown"),
        F.filter(F.array_distinct(cited), lambda x: F.size(F.filter(cited, lambda y: y == x)) > 1).alias("repeated"),
        F.filter(like, lambda x: ~x.rlike(r"^E\d+$")).alias("malformed"), F.regexp_extract_all(F.col("_t"), F.lit(_LEGACY), F.lit(1)).alias("legacy"),
    )
    return a.withColumn("valid", (F.size("unknown") == 0) & (F.size("malformed") == 0) & (F.size("legacy") == 0) & (F.size("cited") > 0))


def context_blocks(evidence: DataFrame, group: str) -> DataFrame:
    """(group, ``context``): the blocks of a prompt in the order of their ids; a null page has no line. ``title`` may be missing."""
    title = F.col("title") if "title" in evidence.columns else F.lit(None).cast("string")
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("Page: "), F.col("page").cast("string")))
    block = F.concat_ws("\n", F.concat(F.lit("["), "evidence_id", F.lit("]")), F.concat(F.lit("Source: "), source_name(title, F.col("source"))), page, F.concat(F.lit("Content: "), F.coalesce("text", F.lit(""))))
    number = F.substring("evidence_id", 2, 9).cast("int")
    listed = F.array_sort(F.collect_list(F.struct(number.alias("n"), block.alias("b"))))
    return evidence.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def answer_payload(answers: DataFrame, evidence: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ``status``, ``answer``, ``references``, ``warnings``) for display: of answered rows the cited evidence in the order of its ids.

    ``answers`` has status; ``evidence`` key, evidence_id, title, source, page, text, chunk_index, character_start, character_end.  The answer
    of a row that isn't ``answered`` is empty, and it has no references.
    """
    shown = answers.select(key, "status", F.when(F.col("status") == "answered", F.col(text)).otherwise("").alias("answer"))
    cited = shown.select(key, F.explode(F.array_distinct(cited_ids(F.col("answer")))).alias("evidence_id"))
    cards = evidence.withColumn("display_text", excerpt(F.col("text"))).withColumn("reference", reference(F.col("title"), F.col("source"), F.col("page")))
    number = F.substring("evidence_id", 2, 9).cast("int")
    card = F.struct(number.alias("n"), F.col("evidence_id").alias("id"), "reference", "source", "page", "text", "display_text", (F.col("chunk_index") + 1).alias("passage"), "character_start", "character_end")
    listed = cited.join(cards, [key, "evidence_id"]).groupBy(key).agg(F.array_sort(F.collect_list(card)).alias("references"))
    warnings = F.when(F.size("references") > 0, coverage_warnings(F.col("answer"))).otherwise(F.array().cast("array<string>"))
    out = shown.join(listed, key, "left")
    none = F.array().cast(out.schema["references"].dataType)
    return out.withColumn("references", F.coalesce("references", none)).withColumn("warnings", warnings)
