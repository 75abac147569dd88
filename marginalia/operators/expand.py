"""Context around chosen passages: neighbours, containment, merged intervals, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_paragraphs(rows: DataFrame, document: list[str], order: list[str]) -> DataFrame:
    """Adds ``position``: the paragraph's number in its document, over pages."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*document).orderBy(*order)))


def neighbours(anchors: DataFrame, rows: DataFrame, document: list[str], radius: int, *, same_section: bool = False) -> DataFrame:
    """Pairs of an anchor and the rows of its document up to ``radius`` positions away, the anchor's own not among them.

    A band join as an equality join: each anchor names the positions it wants, so no pair outside of
    the band is ever made.  Adds ``anchor_id``, ``distance``.
    """
    wanted = anchors.select(*document, F.col("id").alias("anchor_id"), F.col("position").alias("_at"), *([F.col("section_id").alias("_section")] if same_section else []), F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position"))
    found = wanted.where(F.col("position") != F.col("_at")).join(rows, [*document, "position"])
    if same_section:
        found = found.where(F.col("_section") == F.col("section_id")).drop("_section")
    return found.withColumn("distance", F.abs(F.col("position") - F.col("_at"))).drop("_at")


def merge_intervals(rows: DataFrame, group: list[str], *, joins: Column | None = None, carry: str | None = None) -> DataFrame:
    """(group, ``block``, ``start``, ``end``, ``ids``): intervals that overlap or touch in one block.

    ``joins`` tells when an interval behind a gap joins the one before all the same; it may use ``_reach``, the end so far, and
    ``_carried``, the value of the column ``carry`` where that end is.
    """
    order = W.partitionBy(*group).orderBy("start", "end", "id")
    tail = F.struct("end", F.col(carry).alias("carried")) if carry else F.struct("end")
    reach = F.max(tail).over(order.rowsBetween(W.unboundedPreceding, -1))
    seen = rows.withColumn("_tail", reach).withColumn("_reach", F.col("_tail.end"))
    seen = seen.withColumn("_carried", F.col("_tail.carried")) if carry else seen
    opens = F.col("_reach").isNull() | ~((F.col("start") <= F.col("_reach")) | (F.lit(False) if joins is None else F.coalesce(joins, F.lit(False))))
    blocks = seen.withColumn("block", F.sum(opens.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return blocks.groupBy(*group, "block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("id")).alias("ids"))


def contained(spans: DataFrame, blocks: DataFrame, group: list[str]) -> DataFrame:
    """Spans that lie within a block of their group, with the block's number."""
    b = blocks.select(*group, "block", F.col("start").alias("_from"), F.col("end").alias("_to"))
    return spans.join(b, group).where((F.col("_from") <= F.col("start")) & (F.col("end") <= F.col("_to"))).drop("_from", "_to")


def overlapping(paragraphs: DataFrame, blocks: DataFrame, group: list[str]) -> DataFrame:
    """Paragraphs that share a character with a block."""
    b = blocks.select(*group, "block", F.col("start").alias("_from"), F.col("end").alias("_to"))
    return paragraphs.join(b, group).where((F.col("start") < F.col("_to")) & (F.col("end") > F.col("_from"))).drop("_from", "_to")
