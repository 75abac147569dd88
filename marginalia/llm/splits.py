"""Splits that keep related records together.

Records are related by equal keys, directly or through other records.  The
connected components are found by hash-to-min: every node keeps a cluster, sends
the whole cluster to its smallest member and that member to all the others, until
nothing changes.  Clusters are rows (node, member), never arrays, so a component that
holds a third of all records is spread like any other data.  Components then go to
splits by weighted rendezvous hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.terms import fold_case
from marginalia.runtime import Scratch, join_with_hot

#: A node or component with more than one part in so many of all rows counts as large: there are fewer of them than this.
LARGE_PART = 2000
MOST_ROUNDS = 60


def text_key(c: Column) -> Column:
    """A text but for letter case and white space of any kind; null if nothing remains."""
    bare = F.regexp_replace(fold_case(F.upper(c)), r"(?U)\s+", "")
    return F.when(bare != "", bare)


def path_key(c: Column) -> Column:
    """A file but for letter case and the notation of its path; null if nothing remains.

    Backslashes, doubled slashes, ``.`` and ``..`` steps, percent encoding and outer white space
    don't count.  A path that can't be decoded is taken as written.
    """
    slashed = F.regexp_replace(c, r"\\", "/")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(slashed, r"\+", "%2B")), slashed)
    plain = F.regexp_replace(fold_case(F.upper(F.regexp_replace(decoded, r"\\", "/"))), r"(?U)^\s+|\s+$", "")
    steps = F.filter(F.split(plain, "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    joined = F.array_join(walked, "/")
    return F.when(joined != "", joined)


def _fingerprint(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first())


def hash_to_min(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(``node``, ``component``) of the nodes of (``a``, ``b``) edges; a component is its smallest node.

    A round shuffles the clusters once by node; nodes with very large clusters
    (fewer than ``LARGE_PART``, by definition) are joined to their minimum by broadcast.
    Each round is written to the shared folder and replaces the one before.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    nodes = both.select("v").distinct()
    pairs = scratch.write(both.unionByName(nodes.select("v", F.col("v").alias("u"))).distinct(), "pairs-0")
    seen = _fingerprint(pairs)
    for turn in range(1, MOST_ROUNDS + 1):
        least = scratch.write(pairs.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), f"least-{turn}")
        large = [r[0] for r in least.where(F.col("n") > max(seen[0] // LARGE_PART, 1000)).select("v").limit(LARGE_PART).collect()]
        sent = join_with_hot(pairs, least.select("v", "m"), "v", large)
        moved = sent.select(F.col("m").alias("v"), "u").unionByName(sent.select(F.col("u").alias("v"), F.col("m").alias("u")))
        new = scratch.write(moved.distinct(), f"pairs-{turn}")
        scratch.drop(f"pairs-{turn - 1}")
        scratch.drop(f"least-{turn}")
        now = _fingerprint(new)
        pairs = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not stable after {MOST_ROUNDS} rounds")
    return pairs.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def related_groups(df: DataFrame, key: str, relations: list[Column]) -> DataFrame:
    """(``key``, ``group_id``) for every distinct non-null key: rows with equal relations, or joined by a chain of such, share a group.

    ``group_id`` is the smallest key of the group.  Null relations join nothing; all
    rows with the same key belong together.  An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "groups")
    names = [f"_r{i}" for i in range(len(relations))]
    # 128-bit digests: long values don't travel.
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_key"), *(F.unhex(F.md5(r)).alias(n) for r, n in zip(relations, names)))
    rows = scratch.write(rows.distinct(), "rows")
    edges = None
    for n in names:
        own = rows.where(F.col(n).isNotNull()).select("_key", F.col(n).alias("_r"))
        least = scratch.write(own.groupBy("_r").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n")), f"least{n}")
        total = own.count()
        large = [r[0] for r in least.where(F.col("_n") > max(total // LARGE_PART, 1000)).select("_r").limit(LARGE_PART).collect()]
        found = join_with_hot(own, least.drop("_n"), "_r", large).where("_key <> _least").select(F.col("_key").alias("a"), F.col("_least").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
    keys = rows.select("_key").distinct()
    component = hash_to_min(edges, scratch).withColumnRenamed("node", "_key")
    return keys.join(component, "_key", "left").select(F.col("_key").alias(key), F.coalesce("component", "_key").alias("group_id"))


def _rendezvous(group: Column, weights: dict[str, float]) -> Column:
    """The split with the highest score -w / ln(h), h a hash of group and split in (0, 1)."""
    scored = [
        F.struct((-F.lit(w) / F.log((F.pmod(F.xxhash64(group, F.lit(s)), F.lit(1 << 53)) + 0.5) / float(1 << 53))).alias("score"), F.lit(s).alias("split")) for s, w in sorted(weights.items()) if w > 0
    ]
    return F.array_max(F.array(*scored))["split"] if scored else F.lit(None).cast("string")


def assign_splits(groups: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(``key``, ``group_id``, ``target_split``): whole groups to splits with about the wanted shares of rows.

    Groups follow by weighted rendezvous hashing, so a change of one share moves only the groups it must and growth of
    the table moves none.  Only a group that holds more than a tenth of the smallest share (and at least 1/``LARGE_PART`` of the rows,
    so there are fewer than that many) would upset the shares wherever its hash falls: such go, largest first, to the split that lacks
    most, and what is still lacking weighs the others.  ``targets`` is a fixed table; shares
    are taken relative to their sum, rows without split or positive share don't count, and without any
    the split is null.
    """
    spark = groups.sparkSession
    scratch = Scratch(spark, "splits")
    groups = scratch.write(groups, "groups")
    wanted = targets.where("target_split IS NOT NULL AND share > 0").groupBy("target_split").agg(F.sum("share").alias("share")).collect()
    whole = sum(r["share"] for r in wanted)
    total = groups.count()
    lacking = {r["target_split"]: r["share"] / whole * total for r in sorted(wanted)}
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    least = max(min(lacking.values()) / 10, total / LARGE_PART, 1) if lacking else 0
    large = sizes.where(F.col("n") > least).orderBy(F.desc("n"), "group_id").limit(LARGE_PART).collect() if lacking else []
    placed = []
    for r in large:
        best = max(sorted(lacking), key=lambda s: lacking[s])
        lacking[best] -= r["n"]
        placed.append((r["group_id"], best))
    rest = {s: max(v, 0.0) for s, v in lacking.items()} if placed else {r["target_split"]: r["share"] for r in wanted}
    if lacking and not any(rest.values()):
        rest = {r["target_split"]: r["share"] for r in wanted}
    out = groups.withColumn("_hashed", _rendezvous(F.col("group_id"), rest))
    known = spark.createDataFrame(placed, "group_id bigint, _placed string")
    out = out.join(F.broadcast(known), "group_id", "left")  # at most LARGE_PART rows
    return out.select(key, "group_id", F.coalesce("_placed", "_hashed").alias("target_split"))
