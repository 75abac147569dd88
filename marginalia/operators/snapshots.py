"""What changed between consecutive full snapshots of a table.

Keys get persistent ordinals, each snapshot becomes one compressed bitmap of
ordinals plus ordinal-aligned vectors of value fingerprints, and consecutive
snapshots are compared set against set: ``current AND NOT previous`` is what was
added, ``previous AND NOT current`` what was removed, and the vectors are compared
at the ordinals of ``current AND previous``.

Ordinals are dense inside a hash block of keys, so no global sort or single
counter is needed: (block, ordinal) is the persistent identity of a key.  The number
of blocks belongs to the ordinals and is stored with them; what is compared at once
is a segment of a block's ordinals, so blocks may grow.  :class:`SnapshotState` keeps ordinals and the last
snapshot between runs, so that a new delivery is compared without the earlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.bitmap import CompressedBitmap
from marginalia.runtime import Scratch, blocks_for

ROWS_PER_BLOCK = 65_536
SEGMENT_BITS = 16  # ordinals compared at once
_NULL = "\u0000null"


def hex_digest(c: Column) -> Column:
    """The hexadecimal digits of a digest, however written: case, blanks, separators and an algorithm prefix don't count."""
    bare = F.regexp_replace(F.lower(c), r"^\s*sha-?256\s*[:=]?", "")
    return F.regexp_replace(bare, r"[^0-9a-f]", "")


def path_set(c: Column) -> Column:
    """The sorted set of paths in a JSON list; null, blank and ``null`` are the empty set, text that isn't a JSON list is one path."""
    parsed = F.from_json(c, "array<string>")
    empty = F.array().cast("array<string>")
    paths = F.array_sort(F.array_distinct(F.filter(parsed, lambda p: p.isNotNull())))
    return F.when(c.isNull() | F.trim(c).isin("", "null"), empty).when(parsed.isNull(), F.array(c)).otherwise(paths)


def _fingerprints(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: equal values agree, different ones disagree but for a chance of 2**-128 a pair."""
    return F.xxhash64(c), F.xxhash64(F.lit("second"), c)


def latest_per_snapshot(df: DataFrame, snapshot: str, key: str, values: dict[str, Column], version: str) -> DataFrame:
    """One row per snapshot and key: the one with the greatest ``version`` (null lowest).

    Rows without snapshot or key don't count.  Of rows that tie in ``version``
    the one with the greatest fingerprints is taken, the same one on every run.
    Only fingerprints of the values are shuffled, pre-aggregated per task, so a key
    with very many deliveries doesn't collect in one task.
    """
    prints = [(f"_f{i}_{j}", p) for i, c in enumerate(values.values()) for j, p in enumerate(_fingerprints(F.coalesce(c, F.lit(_NULL))))]
    slim = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull() & (F.trim(F.col(key)) != "")).select(
        F.col(snapshot).cast("int").alias("_snapshot"), F.col(key).cast("string").alias("_key"), F.col(version).alias("_version"), *(p.alias(n) for n, p in prints)
    )
    best = slim.groupBy("_snapshot", "_key").agg(F.max(F.struct("_version", *(n for n, _ in prints))).alias("_best"))
    return best.select("_snapshot", "_key", *(F.col(f"_best.{n}").alias(n) for n, _ in prints))


def with_ordinals(rows: DataFrame, blocks: int, known: DataFrame | None = None) -> DataFrame:
    """Adds ``_block`` and ``_ordinal`` to rows with ``_key`` and ``_snapshot``.

    ``known`` has _block, _key and _ordinal of earlier runs with the same
    number of blocks; its keys keep their ordinals and new keys are appended behind
    them in the order of their first snapshot, then by key.
    """
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int")).repartition("_block")
    if known is None:
        rows = rows.withColumn("_old", F.lit(None).cast("int"))
    else:
        rows = rows.join(known.select(F.col("_block"), F.col("_key"), F.col("_ordinal").alias("_old")).repartition("_block"), ["_block", "_key"], "left")
        base = known.groupBy("_block").agg(F.max("_ordinal").alias("_base"))
        rows = rows.join(base, "_block", "left")  # one row a block; by size, not by hint
    first = F.min("_snapshot").over(W.partitionBy("_block", "_key"))
    fresh = F.dense_rank().over(W.partitionBy("_block", F.col("_old").isNull()).orderBy("_first", "_key"))
    start = F.coalesce(F.col("_base"), F.lit(-1)) if known is not None else F.lit(-1)
    return rows.withColumn("_first", first).withColumn("_ordinal", F.coalesce(F.col("_old"), start + fresh).cast("int")).drop("_old", "_first", "_base")


def _compare_block(snapshots: list[int], prints: list[str]):
    def run(table: pa.Table) -> pa.Table:
        number = table["_snapshot"].to_numpy()
        ordinal = table["_ordinal"].to_numpy() & ((1 << SEGMENT_BITS) - 1)
        n = int(ordinal.max()) + 1
        first_row = np.zeros(n, dtype=np.int64)
        first_row[ordinal] = np.arange(len(ordinal))
        columns = [table[p].to_numpy() for p in prints]
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], snapshots, side="left")
        ends = np.searchsorted(number[order], snapshots, side="right")

        def load(i: int) -> tuple[CompressedBitmap, list[np.ndarray]]:
            rows = order[starts[i] : ends[i]]
            vectors = []
            for c in columns:
                v = np.zeros(n, dtype=np.int64)
                v[ordinal[rows]] = c[rows]
                vectors.append(v)
            return CompressedBitmap.of(ordinal[rows]), vectors

        out_no, out_row, out_kind = [], [], []
        before = load(0)
        for i in range(1, len(snapshots)):
            now = load(i)
            common = now[0].and_(before[0]).ordinals()
            differs = reduce(np.logical_or, (a[common] != b[common] for a, b in zip(now[1], before[1])), np.zeros(len(common), dtype=bool))
            for kind, found in enumerate((now[0].and_not(before[0]).ordinals(), before[0].and_not(now[0]).ordinals(), common[differs])):
                out_no.append(np.full(len(found), snapshots[i], dtype=np.int32))
                out_row.append(first_row[found])
                out_kind.append(np.full(len(found), kind, dtype=np.int8))
            before = now
        kinds = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(out_kind)), pa.array(["added", "removed", "changed"])).cast(pa.string())
        keys = table["_key"].combine_chunks().take(pa.array(np.concatenate(out_row)))
        return pa.table({"_snapshot": pa.array(np.concatenate(out_no)), "_key": keys.cast(pa.string()), "_kind": kinds})

    return run


@dataclass
class SnapshotState:
    """What a run leaves to the next: ordinals of all keys so far, and the fingerprints of the last snapshot's rows.

    ``rows``: _block, _key, _ordinal, _present and the fingerprints (null where not present).  Stored as two
    tables in one folder; the small one, written last, tells blocks and snapshot and makes the folder readable.
    """

    rows: DataFrame
    blocks: int
    snapshot: int | None

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.rows.sparkSession.createDataFrame([(self.blocks, self.snapshot)], "blocks int, snapshot int").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SnapshotState:
        head = spark.read.parquet(f"{path}/head").first()
        return cls(spark.read.parquet(f"{path}/rows"), head["blocks"], head["snapshot"])


def snapshot_changes(
    df: DataFrame, snapshot: str, key: str, values: dict[str, Column], version: str, *, blocks: int | None = None, state: SnapshotState | None = None
) -> DataFrame:
    """Rows (``snapshot``, ``key``, ``change_kind``) for each snapshot against the next lower one present.

    ``values`` names the compared expressions over ``df``; two values are the same
    if equal, null equals only null.  All snapshot numbers in ``df`` are present,
    also one whose rows all lack a key; the first gives no case.  Repeated rows
    and late rows count by :func:`latest_per_snapshot`.  An empty table gives no rows.
    The numbers of the snapshots (not their rows) come to the driver.  With the ``state`` of an earlier run see :func:`changes_since`.
    """
    return changes_since(df, snapshot, key, values, version, blocks=blocks, state=state)[0]


def changes_since(
    df: DataFrame, snapshot: str, key: str, values: dict[str, Column], version: str, *, blocks: int | None = None, state: SnapshotState | None = None, scratch: Scratch | None = None
) -> tuple[DataFrame, SnapshotState]:
    """The changes of :func:`snapshot_changes`, and the state to go on from.

    With ``state``, ``df`` holds later snapshots only (a lower or equal number is an error: it was compared
    already), and the first of them is compared with the state's snapshot.  ``blocks`` can't differ from the state's.
    """
    if state is not None and blocks not in (None, state.blocks):
        raise ValueError(f"the ordinals were made with {state.blocks} blocks, not {blocks}")
    blocks = state.blocks if state is not None else blocks or blocks_for(df.count(), ROWS_PER_BLOCK)
    numbers = sorted(r[0] for r in df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).cast("int")).distinct().collect())
    rows = latest_per_snapshot(df, snapshot, key, values, version)
    prints = [c for c in rows.columns if c.startswith("_f")]
    known = None
    if state is not None:
        if state.snapshot is not None and numbers and numbers[0] <= state.snapshot:
            raise ValueError(f"snapshot {numbers[0]} isn't later than {state.snapshot}, which was compared already")
        known = state.rows
        if state.snapshot is not None:
            numbers = [state.snapshot, *numbers]
            rows = rows.unionByName(known.where("_present").select(F.lit(state.snapshot).alias("_snapshot"), "_key", *prints))
    numbered = with_ordinals(rows, blocks, known)
    if scratch is not None:
        numbered = scratch.write(numbered, "numbered")
    last = numbers[-1] if numbers else None
    now = numbered.groupBy("_block", "_key").agg(F.min("_ordinal").alias("_ordinal"), F.max(F.col("_snapshot") == F.lit(last)).alias("_present"), *(F.max(F.when(F.col("_snapshot") == F.lit(last), F.col(p))).alias(p) for p in prints))
    if known is not None:
        gone = known.join(now.select("_block", "_key"), ["_block", "_key"], "left_anti").select("_block", "_key", "_ordinal", F.lit(False).alias("_present"), *(F.lit(None).cast("bigint").alias(p) for p in prints))
        now = now.unionByName(gone)
    if len(numbers) < 2:
        found = df.sparkSession.createDataFrame([], "a int, b string, change_kind string")
    else:
        out = "_snapshot int, _key string, _kind string"
        found = numbered.groupBy("_block", F.shiftright("_ordinal", SEGMENT_BITS).alias("_segment")).applyInArrow(_compare_block(numbers, prints), out)
    return found.toDF(snapshot, key, "change_kind"), SnapshotState(now, blocks, last)


def _manifest_values() -> dict[str, Column]:
    return {"digest": hex_digest(F.col("file_hash")), "paths": F.to_json(path_set(F.col("source_paths")))}


def manifest_changes(df: DataFrame, **options: object) -> DataFrame:
    """:func:`snapshot_changes` for deliveries of the library manifest: digest and path set of each document."""
    return snapshot_changes(df, "snapshot_no", "document_id", _manifest_values(), "loaded_at", **options)


def manifest_changes_since(df: DataFrame, **options: object) -> tuple[DataFrame, SnapshotState]:
    return changes_since(df, "snapshot_no", "document_id", _manifest_values(), "loaded_at", **options)
