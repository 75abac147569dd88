import random

from pyspark.sql import functions as F

from marginalia.llm.splits import assign_splits, hash_to_min, path_key, related_groups, text_key
from marginalia.runtime import Scratch

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5), ("none", 0.0)]


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 1700)] + [(i, j) for i in range(2000, 2012) for j in range(2000, i)]
    edges += [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(250)]
    edges = [(a, b) for a, b in edges if a != b]
    want = union_find(edges, {n for e in edges for n in e})
    got = hash_to_min(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()
    assert {r.node: r.component for r in got} == want


def test_keys(spark):
    rows = [(" A b C\n", "./X//y.PDF"), ("abc", "x\\y.pdf"), (None, None), ("  ", " "), ("straße", "a%20b/../c%20d.pdf"), ("STRASSE", "C D.pdf"), ("q", "100%.pdf")]
    df = spark.createDataFrame(rows, "q string, s string").select(text_key(F.col("q")).alias("q"), path_key(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in df] == [("abc", "x/y.pdf"), ("abc", "x/y.pdf"), (None, None), (None, None), ("strasse", "c d.pdf"), ("strasse", "c d.pdf"), ("q", "100%.pdf")]


def test_groups_nulls_repeats_and_empty(spark):
    rows = [(5, "a", "f1"), (3, "a", "f2"), (9, "b", "f2"), (7, None, None), (8, "  ", ""), (9, "b", "f2"), (2, "c", None), (2, "d", None), (1, "d", "f9"), (None, "a", "f1")]
    df = spark.createDataFrame(rows, "label_id bigint, query string, source string").withColumn("_key", F.lit("clash")).withColumn("group_id", F.lit("clash"))
    groups = lambda d: {r.label_id: r.group_id for r in related_groups(d, "label_id", [text_key(F.col("query")), path_key(F.col("source"))]).collect()}
    assert groups(df) == {5: 3, 3: 3, 9: 3, 7: 7, 8: 8, 2: 1, 1: 1}
    assert groups(df.limit(0)) == {}


def test_hot_source(spark):
    df = spark.range(6000).select(F.col("id").alias("label_id"), F.concat(F.lit("q"), F.col("id")).alias("query"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 1000)).alias("source"))
    got = {r.label_id: r.group_id for r in related_groups(df, "label_id", [F.col("query"), F.col("source")]).collect()}
    want = union_find([], range(6000))
    first = {}
    for i in range(6000):
        want[i] = first.setdefault("hot" if i % 3 == 0 else f"s{i % 1000}", i)
    assert got == want


def test_shares_are_met_with_a_giant_group_and_groups_stay_whole(spark):
    rng = random.Random(1)
    rows = [(i, 0) for i in range(3000)] + [(i, 10_000 + rng.randint(0, 2500)) for i in range(3000, 10_000)]
    targets = spark.createDataFrame(TARGETS, "target_split string, share double")
    df = spark.createDataFrame(rows, "label_id bigint, group_id bigint")
    out = assign_splits(df, targets, "label_id")
    again = assign_splits(df.repartition(3), targets, "label_id")
    assert sorted(out.collect()) == sorted(again.collect())
    assert out.groupBy("group_id").agg(F.count_distinct("target_split").alias("n")).where("n <> 1").count() == 0
    shares = {r.target_split: r["count"] / 10_000 for r in out.groupBy("target_split").count().collect()}
    assert set(shares) == {"train", "validation", "test"} and all(abs(shares[s] - w) < 0.02 for s, w in TARGETS[:3])
    assert [r.target_split for r in assign_splits(df.limit(2), targets.limit(0), "label_id").collect()] == [None, None]
    assert assign_splits(df.limit(0), targets, "label_id").collect() == []
