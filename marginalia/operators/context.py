"""Context around chosen passages: which paragraphs may come along, which do within the budgets, and the blocks they make.

Anchors, paragraphs and pages are relations: (query_id, rank, id, document_id, page, start, end, section_id),
(document_id, page, paragraph, start, end, section_id) and (document_id, page, text).  Candidates are found by an equality join on positions
and merged by windows.  Only the choice within budgets, where each addition depends on those before, runs group
by group, over the few spans of one query.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.config import ContextConfig
from marginalia.operators.expand import merge_intervals, number_paragraphs

DOCUMENT = ["document_id"]


def utf8_bytes(text: str) -> int:
    """The cautious counter: a token for each byte."""
    return len(text.encode())


def tokenizer_counter(encode: Callable[[str], list]) -> Callable[[str], int]:
    """A counter by the tokenizer of the answering model."""
    return lambda text: len(encode(text))


def candidate_spans(anchors: DataFrame, paragraphs: DataFrame, radius: int, same_section: bool = True) -> DataFrame:
    """(query_id, rank, distance, document_id, page, start, end, section_id): paragraphs up to ``radius`` from those an anchor touches, over pages.

    ``distance`` 0 are the anchor's own paragraphs.  A paragraph near several anchors comes once for each.
    """
    placed = number_paragraphs(paragraphs, DOCUMENT, ["page", "start", "end", *(["id"] if "id" in paragraphs.columns else [])])
    span = placed.select("document_id", "page", F.col("start").alias("_from"), F.col("end").alias("_to"), "position")
    touched = anchors.join(span, ["document_id", "page"]).where((F.col("_from") < F.col("end")) & (F.col("_to") > F.col("start")))
    reach = touched.groupBy("query_id", "rank", "document_id", F.col("section_id").alias("_section")).agg(F.min("position").alias("_low"), F.max("position").alias("_high"))
    wanted = reach.select("*", F.explode(F.sequence(F.col("_low") - radius, F.col("_high") + radius)).alias("position"))
    found = wanted.join(placed, ["document_id", "position"])
    if same_section:
        found = found.where(F.col("section_id").eqNullSafe(F.col("_section")))
    distance = F.greatest(F.col("_low") - F.col("position"), F.col("position") - F.col("_high"), F.lit(0))
    return found.select("query_id", "rank", distance.alias("distance"), "document_id", "page", "start", "end", "section_id")


def blocks(anchors: DataFrame, spans: DataFrame, joins: Column | None = None) -> DataFrame:
    """(query_id, block_rank, document_id, page, start, end, ranks, n_anchors, kind): anchors and spans merged, the block of the best anchor first.

    ``joins`` may join spans over a gap; it can use ``_reach`` (the end so far), ``_carried`` (the section there), ``start`` and ``section_id``.
    ``ranks`` are the anchors a block belongs to, ``n_anchors`` counts those it contains.  Kinds: ``anchor`` (nothing but one anchor),
    ``anchor_context`` and ``expansion``.
    """
    page = ["query_id", "document_id", "page"]
    own = anchors.select(*page, "start", "end", "section_id", F.col("rank").alias("id"))
    merged = merge_intervals(own.unionByName(spans.select(*page, "start", "end", "section_id", F.col("rank").alias("id"))), page, joins=joins, carry="section_id")
    inside = anchors.select(*page, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("rank").alias("_r"))
    # A block holds an anchor of its page or not: anchors of a query are few.
    held = merged.join(inside, page, "left").groupBy(*page, "block", "start", "end", "ids").agg(
        F.count(F.when((F.col("_s") >= F.col("start")) & (F.col("_e") <= F.col("end")), 1)).alias("n_anchors"), F.max(F.coalesce((F.col("_s") == F.col("start")) & (F.col("_e") == F.col("end")), F.lit(False))).alias("_exact")
    )
    kind = F.when((F.col("n_anchors") == 1) & F.col("_exact"), "anchor").when(F.col("n_anchors") > 0, "anchor_context").otherwise("expansion")
    order = W.partitionBy("query_id").orderBy(F.array_min("ids"), "page", "start", "document_id")
    return held.select("query_id", F.row_number().over(order).alias("block_rank"), "document_id", "page", "start", "end", F.col("ids").alias("ranks"), "n_anchors", kind.alias("kind"))


def blank_gap(text: str = "text") -> Column:
    """For ``joins``: nothing but white space between, and the same section on both sides."""
    gap = F.substring(F.col(text), F.col("_reach") + 1, F.col("start") - F.col("_reach"))
    return ~gap.rlike(r"(?U)\S") & F.col("section_id").eqNullSafe(F.col("_carried"))


class BudgetExceeded(ValueError):
    """The anchors alone don't fit; they are never cut."""


def _admit(config: ContextConfig, count: Callable[[str], int], fixed: int):
    """Of one query's spans those that fit, strongest anchor and nearest first."""

    def cost(spans: dict[tuple, list[tuple[int, int]]], texts: dict[tuple, str]) -> int:
        """Tokens of the blocks that spans make; spans that touch or have white space between are one block."""
        total = 0
        for key, own in spans.items():
            begin = end = None
            for a, b in [*sorted(own), (None, None)]:
                if begin is not None and (a is None or (a > end and texts[key][end:a].strip())):
                    total += count(f"[E0]\nSource: {key[0]}\nPage: {key[1]}\nContent: {texts[key][begin:end]}\n\n---\n\n")
                    begin = None
                if a is not None:
                    begin, end = (a, b) if begin is None else (begin, max(end, b))
        return total

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = {(d, p): t for d, p, t in zip(pdf["document_id"], pdf["page"], pdf["text"])}
        rows = pdf.sort_values(["rank", "distance", "page", "start", "end"], kind="stable").to_dict("records")
        chosen: dict[tuple, list[tuple[int, int]]] = {}
        for r in rows:
            if r["distance"] < 0:
                chosen.setdefault((r["document_id"], r["page"]), []).append((r["start"], r["end"]))
        anchor_tokens = cost(chosen, texts)
        room = min(config.budget_tokens, config.window_tokens - config.answer_reserve - config.retry_reserve - config.framing_reserve - fixed - int(pdf["question_tokens"].iloc[0]))
        if anchor_tokens > room:
            raise BudgetExceeded(f"anchors need {anchor_tokens} tokens of {room}; raise the budgets or choose fewer")
        room = min(room, anchor_tokens + config.expansion_tokens)
        kept = []
        for r in rows:
            if r["distance"] < 0:
                continue
            key = (r["document_id"], r["page"])
            chosen.setdefault(key, []).append((r["start"], r["end"]))
            if cost(chosen, texts) <= room:
                kept.append(r)
            else:
                chosen[key].pop()
                if not chosen[key]:
                    del chosen[key]
        return pd.DataFrame(kept, columns=list(pdf.columns))[["query_id", "rank", "document_id", "page", "start", "end", "section_id"]]

    return run


def expand_context(anchors: DataFrame, pages: DataFrame, paragraphs: DataFrame, questions: DataFrame, config: ContextConfig, *, count: Callable[[str], int] = utf8_bytes, fixed_tokens: int = 0) -> DataFrame:
    """The blocks of :func:`blocks` with ``text`` for each query, within all budgets of ``config``.

    Anchors always come whole: if they alone exceed a budget, the query stops with :class:`BudgetExceeded`.  Then paragraphs are added one by
    one, those of the best anchor and the nearest first, as long as evidence, expansion and prompt budgets hold; one that doesn't fit is
    passed over.  ``fixed_tokens`` is the size of the instructions.  A repeated anchor counts once.
    """
    anchors = anchors.groupBy("query_id", "id").agg(F.min(F.struct("rank", "document_id", "page", "start", "end", "section_id")).alias("_a")).select("query_id", "id", "_a.*")
    spans = candidate_spans(anchors, paragraphs, config.paragraphs, config.same_section) if config.paragraphs and config.expansion_tokens else None
    own = anchors.select("query_id", "rank", F.lit(-1).alias("distance"), "document_id", "page", "start", "end", "section_id")
    both = own if spans is None else own.unionByName(spans)
    asked = questions.select("query_id", F.pandas_udf(lambda t: t.fillna("").map(count), "long")("text").alias("question_tokens"))
    texts = both.join(pages.select("document_id", "page", "text"), ["document_id", "page"]).join(asked, "query_id")
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("query_id", "rank", "document_id", "page", "start", "end", "section_id"))
    kept = texts.groupBy("query_id").applyInPandas(_admit(config, count, fixed_tokens), kinds)
    with_text = lambda df: df.join(pages.select("document_id", "page", "text"), ["document_id", "page"])
    page = ["query_id", "document_id", "page"]
    # Gaps are looked up in the page's text, then the spans so joined make the blocks.
    every = with_text(kept.unionByName(anchors.select(*kept.columns))).withColumnRenamed("rank", "id")
    merged = merge_intervals(every, page, joins=blank_gap(), carry="section_id")
    spans = merged.select(*page, F.explode("ids").alias("rank"), "start", "end", F.lit(None).cast("int").alias("section_id"))
    return with_text(blocks(anchors, spans)).withColumn("text", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
