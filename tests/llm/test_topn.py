import random

from pyspark.sql import functions as F

from marginalia.llm.citations_top import best_citations
from marginalia.llm.topn import skipped, top_n, write_clustered
from marginalia.runtime import Scratch


def brute(rows, n):
    groups = {}
    for g, s, t, i in rows:
        groups.setdefault(g, []).append((-s, -t, i))
    return {(g, r + 1, i) for g, v in groups.items() for r, (_, _, i) in enumerate(sorted(v)[:n])}


def items(seed, hot):
    rng = random.Random(seed)
    rows = [(f"g{rng.randint(0, 200)}", round(rng.random(), 2), round(rng.random(), 1), i) for i in range(3000)]
    rows += [("hot", round(rng.random(), 3), 0.0, 10_000 + i) for i in range(hot)]
    rng.shuffle(rows)
    return rows


ITEMS = "_group string, _score double, _second double, _id bigint"


def test_equals_brute_force_and_skips(spark):
    rows = items(1, 6000)
    laid = write_clustered(spark.createDataFrame(rows, ITEMS), Scratch(spark, "test"), "t", rows_per_file=1500, rows_per_row_group=100)
    for n in (1, 3, 5, 16, 40):
        assert {(r._group, r.rank, r._id) for r in top_n(laid, n).collect()} == brute(rows, n)
    r = skipped(laid, 5).first()
    assert r.n_rows == len(rows) and 0 < r.n_skipped < r.n_row_groups and r.n_rows_skipped > 4000


def test_row_groups_of_several_groups_are_skipped(spark):
    """Groups of 60 rows: their leading 16 stand together, and the other 44 are left out, many groups a row group."""
    rows = [(f"g{i % 50:02}", float(i * 7919 % 3000), 0.0, i) for i in range(3000)]
    laid = write_clustered(spark.createDataFrame(rows, ITEMS), Scratch(spark, "test"), "t", rows_per_file=3000, rows_per_row_group=200)
    r = skipped(laid, 5).first()
    assert r.n_rows_skipped > 2000  # of 2200; a group cut between two files keeps leading items in both
    assert {(r._group, r.rank, r._id) for r in top_n(laid, 5).collect()} == brute(rows, 5)


def test_ties_on_the_boundary_are_not_skipped(spark):
    rows = [("a", 1.0, float(i % 3), i) for i in range(4000)]
    laid = write_clustered(spark.createDataFrame(rows, ITEMS), Scratch(spark, "test"), "t", rows_per_file=500, rows_per_row_group=64)
    assert {(r._group, r.rank, r._id) for r in top_n(laid, 4).collect()} == brute(rows, 4)
    assert top_n(write_clustered(spark.createDataFrame([], ITEMS), Scratch(spark, "test"), "e"), 4).collect() == []


CITATIONS = "citation_id bigint, chunk_id string, scores map<string,double>, loaded_at timestamp, source string, _group string"
CHUNKS = "chunk_id string, source string, loaded_at timestamp, _id string"


def test_citations_rules(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, 1 + n)
    s = lambda a, b=None: {"reranker_score": a, "rrf_score": b}
    c = [
        (1, "x", s(0.9), t(0), None, "z"), (1, "x", s(0.1), t(1), None, "z"), (2, "x", s(0.5, 0.2), t(0), None, "z"), (3, "x", {"reranker_score": 0.5}, t(0), None, "z"), (4, "x", s(float("nan")), t(0), None, "z"),
        (5, "x", s(float("inf")), t(0), None, "z"), (6, "x", None, t(0), None, "z"), (7, "gone", s(1.0), t(0), None, "z"), (8, "blank", s(1.0), t(0), None, "z"), (9, "none", s(1.0), t(0), None, "z"), (10, None, s(1.0), t(0), None, "z"),
        (None, "x", s(1.0), t(0), None, "z"), (11, "y", s(0.5, float("nan")), None, None, "z"), (12, "y", s(0.5, 0.0), t(0), None, "z"), (12, "y", s(0.5, 0.0), t(0), None, "z"),
    ]
    k = [("x", "old.pdf", t(0), "q"), ("x", "new.pdf", t(5), "q"), ("y", " y.pdf", t(0), "q"), ("blank", "  ", t(0), "q"), ("none", None, t(0), "q"), (None, "a.pdf", t(0), "q")]
    out = best_citations(spark.createDataFrame(c, CITATIONS), spark.createDataFrame(k, CHUNKS), 5).collect()
    assert sorted((r.source, r["rank"], r.citation_id) for r in out) == [(" y.pdf", 1, 11), (" y.pdf", 2, 12), ("new.pdf", 1, 2), ("new.pdf", 2, 3), ("new.pdf", 3, 1)]


def test_hot_chunk_and_empty_tables(spark):
    c = spark.range(3000).select(F.col("id").alias("citation_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("chunk_id"), F.create_map(F.lit("reranker_score"), (F.col("id") * 37 % 101).cast("double")).alias("scores"), F.current_timestamp().alias("loaded_at"))
    k = c.select("chunk_id").distinct().select("chunk_id", F.when(F.col("chunk_id") == "hot", "h").otherwise(F.substring("chunk_id", 1, 2)).alias("source"), F.current_timestamp().alias("loaded_at"))
    rows = [(("h" if i % 3 == 0 else f"c{i % 500}"[:2]), float(i * 37 % 101), 0.0, i) for i in range(3000)]
    assert {(r.source, r["rank"], r.citation_id) for r in best_citations(c, k).collect()} == brute(rows, 5)
    assert best_citations(c.limit(0), k).collect() == []
    assert best_citations(c, k.limit(0)).collect() == []
