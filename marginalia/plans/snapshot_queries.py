"""Problem 1: what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.snapshots import SnapshotState, manifest_changes, manifest_changes_since
from marginalia.plans.tables import table
from marginalia.runtime import Scratch


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_changes(table(spark, sf_dir, "sync_snapshots"))


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_documents"))


def p1_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes, found in two runs: the second knows the first only by the stored ordinals and last snapshot."""
    df, scratch = table(spark, sf_dir, "sync_snapshots"), Scratch(spark, "two-runs")
    numbers = sorted(r[0] for r in df.where("snapshot_no IS NOT NULL").select("snapshot_no").distinct().collect())
    half = numbers[len(numbers) // 2]
    first, state = manifest_changes_since(df.where(F.col("snapshot_no") <= half))
    state.save(scratch.path("state"))
    second, _ = manifest_changes_since(df.where(F.col("snapshot_no") > half), state=SnapshotState.load(spark, scratch.path("state")))
    return first.unionByName(second)


QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts, "p1_two_runs": p1_two_runs}

_CHANGES = r"""
WITH numbered AS (
  SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before_no
  FROM (SELECT DISTINCT snapshot_no FROM sync_snapshots WHERE snapshot_no IS NOT NULL)),
ranked AS (
  SELECT snapshot_no, document_id,
    regexp_replace(regexp_replace(lower(file_hash), '^\s*sha-?256\s*[:=]?', ''), '[^0-9a-f]', '', 'g') AS digest,
    CASE WHEN source_paths IS NULL OR trim(source_paths) IN ('', 'null') THEN [] ELSE list_sort(list_distinct(from_json(source_paths, '["VARCHAR"]'))) END AS paths,
    row_number() OVER (PARTITION BY snapshot_no, document_id ORDER BY loaded_at DESC NULLS LAST) AS rn
  FROM sync_snapshots WHERE document_id IS NOT NULL AND trim(document_id) <> ''),
latest AS (SELECT * FROM ranked WHERE rn = 1),
pairs AS (
  SELECT n.snapshot_no AS now_no, a.document_id AS now_id, b.document_id AS before_id, a.digest AS d1, b.digest AS d0, a.paths AS p1, b.paths AS p0
  FROM numbered n JOIN latest a ON a.snapshot_no = n.snapshot_no LEFT JOIN latest b ON b.snapshot_no = n.before_no AND b.document_id = a.document_id
  WHERE n.before_no IS NOT NULL
  UNION ALL
  SELECT n.snapshot_no, a.document_id, b.document_id, a.digest, b.digest, a.paths, b.paths
  FROM numbered n JOIN latest b ON b.snapshot_no = n.before_no LEFT JOIN latest a ON a.snapshot_no = n.snapshot_no AND a.document_id = b.document_id
  WHERE a.document_id IS NULL)
SELECT CAST(now_no AS INTEGER) AS snapshot_no, coalesce(now_id, before_id) AS document_id,
  CASE WHEN before_id IS NULL THEN 'added' WHEN now_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM pairs WHERE before_id IS NULL OR now_id IS NULL OR d1 IS DISTINCT FROM d0 OR p1 IS DISTINCT FROM p0
"""

SQL = {
    "p1_found": _CHANGES,
    "p1_two_runs": _CHANGES,
    "p1_change_counts": f"SELECT snapshot_no, change_kind, count(*) AS n_documents FROM ({_CHANGES}) GROUP BY ALL",
}
