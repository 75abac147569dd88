"""Weighted reciprocal rank fusion and candidate budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 12


def query_budgets(total: int, queries: int) -> list[int]:
    """The first query gets half of the total, rounded up; the others share the rest, the earlier ones one more where it doesn't divide."""
    if queries <= 1:
        return [total]
    first = -(-total // 2)
    share, extra = divmod(total - first, queries - 1)
    return [first, *(share + 1 if i < extra else share for i in range(queries - 1))]


def budget(total: int, queries: Column, place: Column) -> Column:
    """:func:`query_budgets` of a table of variants: the budget of the query at ``place`` (0: the original) of ``queries`` in all."""
    first = -(-total // 2)
    rest, others = F.lit(total - first), F.greatest(queries - 1, F.lit(1))
    return F.when(queries <= 1, F.lit(total)).when(place == 0, F.lit(first)).otherwise((F.floor(rest / others) + (place - 1 < rest % others).cast("int")).cast("int"))


def variant_weights(queries: int) -> list[float]:
    """1 for the original query, the variants share another 1."""
    return [1.0, *([1.0 / (queries - 1)] * (queries - 1))] if queries > 1 else [1.0]


def check_weights(weights: list[float], lists: int) -> None:
    if len(weights) != lists or any(not math.isfinite(w) or w < 0 for w in weights):
        raise ValueError("one finite weight of 0 or more is needed for each list")


def reciprocal_rank_fusion(ranked: DataFrame, *, k: int = 60, weight: Column | None = None) -> DataFrame:
    """Fuses ranked lists of each query.

    ``ranked``: query_id, list_no, id, rank and any of distance, dense_score, bm25_score.  An id that
    repeats in a list counts at its first place and the places behind close up.  The result has
    rrf_score (sum of weight / (k + place)), the least distance, the greatest scores, the lists
    that gave the row, and ``rank`` by score, ties by id.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    one = W.partitionBy("query_id", "list_no", "id").orderBy("rank")
    place = W.partitionBy("query_id", "list_no").orderBy("rank", "id")
    listed = ranked.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumn("_place", F.row_number().over(place))
    w = F.lit(1.0) if weight is None else weight
    kept = [(F.min if c == "distance" else F.max)(c).alias(c) for c in ("distance", "dense_score", "bm25_score") if c in ranked.columns]
    fused = listed.groupBy("query_id", "id").agg(F.round(F.sum(w / (F.lit(k) + F.col("_place"))), DIGITS).alias("rrf_score"), *kept, F.array_sort(F.collect_set("list_no")).alias("lists"))
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc("id"))
    return fused.withColumn("rank", F.row_number().over(order))


def reserve_candidates(original: DataFrame, fused: DataFrame, n: int) -> DataFrame:
    """(query_id, id, place): the first half (rounded up) of the original query's list, then the fused order, without repeats, n in all."""
    first = original.where(F.col("rank") <= (n + 1) // 2).select("query_id", "id", F.lit(0).alias("_turn"), "rank")
    both = first.unionByName(fused.select("query_id", "id", F.lit(1).alias("_turn"), "rank"))
    best = both.groupBy("query_id", "id").agg(F.min(F.struct("_turn", "rank")).alias("_at"))
    order = W.partitionBy("query_id").orderBy("_at", "id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("query_id", "id", "place")
