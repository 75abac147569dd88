"""Passages that stand for a whole paper, for questions about one: openings, abstract, contribution, conclusion, direct lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.terms import terms

# Questions about a whole paper or a list of dimensions, sentences that say what a paper does, and headings sought in this order.
OVERVIEW_QUESTION = r"(?i)\b(?:summari[sz]e|summary|overview|contribut\w*|dimensions?|key findings|main findings|key takeaways|main points|what (?:is|are) (?:this|the) (?:paper|survey|article) about)\b"
LIST_QUESTION = r"(?i)\b(?:what|which|list|name|identify)\b.*\bdimensions?\b"
_CLAIM = r"(?i)\b(?:we (?:propose|present|introduce|provide|review|survey|identify|discuss|examine|evaluate|conclude)|this (?:paper|article|survey|work) (?:proposes|presents|introduces|provides|reviews|surveys|discusses|examines|evaluates)|our contributions?)\b"
_DIRECT_LIST = r"(?i)\bdimensions?\b[^:.]{0,120}:\s*[^.]{15,}"
HEADINGS = ("abstract", "contribution", "conclusion", "introduction")
SMALL_WORDS = ("a", "an", "and", "in", "of", "the", "to", "this", "paper")
LEAST_CHARACTERS = 120


def is_overview(question: Column) -> Column:
    return F.coalesce(question.rlike(OVERVIEW_QUESTION), F.lit(False))


def papers_meant(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, paper): for overview questions the papers whose title shares most terms with it; all where none shares any.

    ``questions``: query_id, text; ``papers``: paper, title.
    """
    small = F.array(*(F.lit(w) for w in SMALL_WORDS))
    own = lambda c: F.array_except(F.array_distinct(terms(c)), small)
    asked = questions.where(is_overview(F.col("text"))).select("query_id", F.explode_outer(own(F.col("text"))).alias("term"))
    words = papers.select("paper", F.explode(own(F.col("title"))).alias("term"))
    shared = asked.join(words, "term").groupBy("query_id", "paper").agg(F.count(F.lit(1)).alias("n"))
    best = shared.withColumn("_most", F.max("n").over(W.partitionBy("query_id"))).where("n = _most").select("query_id", "paper")
    without = asked.select("query_id").distinct().join(best, "query_id", "left_anti")
    return best.unionByName(without.crossJoin(papers.select("paper")))  # a question that names no paper is about all of them


def overview_passages(chunks: DataFrame) -> DataFrame:
    """(paper, place, id, reason): up to six passages of each paper in the order in which they should be shown.

    ``overview``: the best opening passage of the first page, the first of each heading, the second opening passage; ``direct_list``
    (place 0): the first passage that lists dimensions.  ``chunks``: id, paper, page, chunk_index, section, text.
    """
    order = [F.asc("page"), F.asc_nulls_first("chunk_index"), F.asc("id")]
    rows = chunks.where("page IS NOT NULL").withColumn("_first", F.min("page").over(W.partitionBy("paper")))
    long = F.length("text") >= LEAST_CHARACTERS
    said = F.regexp_count("text", F.lit(_CLAIM))
    opening = rows.where((F.col("page") == F.col("_first")) & long & (said > 0))
    ranked = opening.withColumn("n", F.row_number().over(W.partitionBy("paper").orderBy(F.desc(said), F.asc(F.regexp_count("text", F.lit("@"))), *order))).where("n <= 2")
    found = ranked.select("paper", F.when(F.col("n") == 1, 1).otherwise(len(HEADINGS) + 2).alias("place"), "id", F.lit("overview").alias("reason"))
    plain = F.lower(F.regexp_replace(F.coalesce("section", F.lit("")), "[*_`#]", ""))
    heads = rows.where(long).withColumn("_h", F.explode(F.array(*(F.struct(F.lit(i + 2).alias("place"), F.lit(h).alias("name")) for i, h in enumerate(HEADINGS))))).where(F.contains(plain, F.col("_h.name")))
    heads = heads.withColumn("n", F.row_number().over(W.partitionBy("paper", "_h.place").orderBy(*order))).where("n = 1")
    found = found.unionByName(heads.select("paper", F.col("_h.place").alias("place"), "id", F.lit("overview").alias("reason")))
    once = found.withColumn("n", F.row_number().over(W.partitionBy("paper", "id").orderBy("place"))).where("n = 1").drop("n")
    lists = rows.where(F.col("text").rlike(_DIRECT_LIST)).withColumn("n", F.row_number().over(W.partitionBy("paper").orderBy(*order))).where("n = 1")
    return once.unionByName(lists.select("paper", F.lit(0).alias("place"), "id", F.lit("direct_list").alias("reason")))


def overview_evidence(questions: DataFrame, chunks: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """(query_id, paper, place, id, reason) for overview questions; ``papers`` (query_id, paper) restricts a question, else titles decide.

    A question for a list takes a paper's direct list alone where there is one.
    """
    named = chunks.groupBy("paper").agg(F.min_by("title", F.struct("page", "id")).alias("title"))
    meant = papers_meant(questions, named) if papers is None else papers.join(questions.where(is_overview(F.col("text"))).select("query_id"), "query_id", "left_semi")
    asked = questions.select("query_id", F.coalesce(F.col("text").rlike(LIST_QUESTION), F.lit(False)).alias("_list"))
    found = meant.join(asked, "query_id").join(overview_passages(chunks), "paper")
    direct = F.max(F.col("reason") == "direct_list").over(W.partitionBy("query_id", "paper")) & F.col("_list")
    return found.withColumn("_direct", direct).where((F.col("reason") == "direct_list") == F.col("_direct")).select("query_id", "paper", "place", "id", "reason")


def merge_overview(overview: DataFrame, results: DataFrame, k: int, cap: int) -> DataFrame:
    """(query_id, id, place): where a query has overview passages, those first and then its results from the same papers, ``cap`` a paper, ``k`` in all.

    If all of them are direct lists, these alone.  Other queries keep their results (query_id, id, paper, place).
    """
    kind = overview.groupBy("query_id").agg(F.min(F.col("reason") == "direct_list").alias("_lists"))
    papers = overview.select("query_id", "paper").distinct()
    first = overview.select("query_id", "id", "paper", F.struct(F.lit(0).alias("a"), F.col("paper").alias("b"), F.col("place").alias("c")).alias("_at"))
    more = results.join(kind.where("NOT _lists").select("query_id"), "query_id", "left_semi").join(papers, ["query_id", "paper"], "left_semi")
    more = more.select("query_id", "id", "paper", F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("place").alias("c")).alias("_at"))
    rest = results.join(kind, "query_id", "left_anti").select("query_id", "id", "place")
    both = first.unionByName(more).groupBy("query_id", "id", "paper").agg(F.min("_at").alias("_at")).join(kind, "query_id")
    nth = F.row_number().over(W.partitionBy("query_id", "paper").orderBy("_at", "id"))
    capped = both.withColumn("_n", nth).where(F.col("_lists") | (F.col("_n") <= cap))
    return capped.select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy("_at", "id")).alias("place")).where(F.col("place") <= k).unionByName(rest)


def with_structural(reserved: DataFrame, overview: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """(query_id, id, place): reserved hits of the original question, then overview passages, then the other candidates, without repeats, n in all."""
    at = lambda df, turn, *by: df.select("query_id", "id", F.lit(turn).alias("_turn"), F.struct(*(F.col(c).cast("string") if c == "paper" else F.col(c) for c in by)).alias("_by"))
    turns = [reserved.withColumn("paper", F.lit("")), overview, candidates.withColumn("paper", F.lit(""))]
    rows = [at(df, turn, "paper", "place") for turn, df in enumerate(turns)]
    best = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("query_id", "id").agg(F.min(F.struct("_turn", "_by")).alias("_at"))
    return best.select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy("_at", "id")).alias("place")).where(F.col("place") <= n)
