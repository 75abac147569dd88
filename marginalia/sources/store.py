"""A versioned chunk store on plain Parquet, where a commit costs what it changes.

Chunks lie in immutable batches, one for each commit.  A version is a manifest: one row a document with its paths, its
status and the batch that holds its chunks; documents that a commit doesn't touch keep their batch.  A version
becomes visible by replacing one small pointer file after its rows were written and read back; until then, and
after any failure, readers see the version before.  A pending file tells what a commit under way writes, so that
:meth:`Store.recover` can finish or undo it.  One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.config import IndexConfig
from marginalia.operators.sync import VISIBLE
from marginalia.sources.folder import Folder, write_json

__all__ = ["Store", "StoreError", "Version", "next_version", "write_json"]

SCHEMA_VERSION = 2
MANIFEST = "document_id string, paths array<string>, status string, batch string, n_chunks bigint"


class StoreError(RuntimeError):
    """``status`` tells what is wrong: missing, legacy, unsupported, incomplete, mismatch."""

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Version:
    name: str
    fingerprint: str
    revision: str
    n_chunks: int
    committed_at: str
    batches: list[str] = field(default_factory=list)
    schema_version: int = SCHEMA_VERSION


def _bag(df: DataFrame) -> list:
    """Aggregates over whole rows, texts and metadata included, by which what was read back is compared with what was written."""
    row = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))))
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).cast("string").alias(f"h{seed}") for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("n"), *sums]


def revision_of(manifest: DataFrame, fingerprint: str) -> str:
    """A digest of all visible documents in order: digests are sorted and hashed in two levels of buckets, so no list is long."""
    row = F.to_json(F.struct("document_id", F.array_sort("paths").alias("paths"), "n_chunks"))
    level = manifest.where(F.col("status").isin(*VISIBLE)).select(F.sha2(F.concat_ws(",", F.lit(fingerprint), row), 256).alias("d"), F.lit("").alias("at"))
    for digits in (4, 2, 0):
        level = level.withColumn("at", F.substring(F.when(F.col("at") == "", F.col("d")).otherwise(F.col("at")), 1, digits) if digits else F.lit(""))
        level = level.groupBy("at").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d"))
    found = level.select("d").collect()
    return found[0][0] if found else ""


class Store:
    def __init__(self, spark: SparkSession, root: object, config: IndexConfig):
        self.spark, self.folder, self.config = spark, Folder(spark, str(root)), config

    def _read(self, name: str) -> dict | None:
        text = self.folder.read(name)
        if text is None:
            return None
        try:
            data = json.loads(text)
        except ValueError as e:
            raise StoreError("incomplete", f"{name} isn't readable: {e}") from e
        if not isinstance(data, dict):
            raise StoreError("incomplete", f"{name} holds no object")
        return data

    def current(self) -> Version | None:
        """The visible version; None if nothing was ever committed; StoreError if it doesn't fit the configuration."""
        data = self._read("current.json")
        if data is None:
            if any(n.startswith("version=") for n in self.folder.names()) and self._read("pending.json") is None:
                raise StoreError("legacy", "there are versions but no pointer; rebuild the index")
            return None
        if data.get("schema_version") != SCHEMA_VERSION:
            raise StoreError("unsupported", f"schema {data.get('schema_version')!r}; supported is {SCHEMA_VERSION}")
        try:
            version = Version(**data)
        except TypeError as e:
            raise StoreError("incomplete", f"the pointer is damaged: {e}") from e
        if version.fingerprint != self.config.fingerprint:
            raise StoreError("mismatch", "the index was made with another configuration; rebuild it")
        return version

    def _version(self) -> Version:
        version = self.current()
        if version is None:
            raise StoreError("missing", "nothing was committed yet")
        return version

    def manifest(self) -> DataFrame:
        """(document_id, paths, status, batch, n_chunks): all documents of the visible version; no rows before the first."""
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self.folder.path(f"version={version.name}"))

    def chunks(self) -> DataFrame:
        """All chunks of the version's documents, with ``batch``; chunks of documents that left it are skipped."""
        version = self._version()
        parts = [self.spark.read.option("mergeSchema", "true").parquet(self.folder.path(f"batch={b}")).withColumn("batch", F.lit(b)) for b in version.batches]
        if not parts:
            raise StoreError("missing", "the version has no chunks")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return rows.join(self.manifest().select("document_id", "batch"), ["document_id", "batch"], "left_semi")

    def visible_chunks(self) -> DataFrame:
        """Chunks of documents that are indexed or stale, with the paths of their document."""
        shown = self.manifest().where(F.col("status").isin(*VISIBLE)).select("document_id", "paths")
        return self.chunks().drop("batch").join(shown, "document_id")

    def get(self, ids: list[str]) -> DataFrame:
        return self.chunks().where(F.col("id").isin(*ids))

    def incomplete(self) -> DataFrame:
        """(document_id, n_chunks, n_stored): visible documents whose stored chunks are not as many as the manifest says."""
        stored = self.chunks().groupBy("document_id").agg(F.count_distinct("id").alias("n_stored"))
        rows = self.manifest().where(F.col("status").isin(*VISIBLE)).join(stored, "document_id", "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0)))
        return rows.where("n_chunks <> n_stored").select("document_id", "n_chunks", "n_stored")

    def commit(self, chunks: DataFrame | None, manifest: DataFrame) -> Version:
        """Writes the chunks of new documents as a batch and a manifest over all documents, and makes them visible.

        ``chunks``: id, document_id and more, of documents whose manifest row has no ``batch`` yet (a manifest without that column
        has none); ``manifest``: document_id, paths, status (indexed, stale, empty, orphaned), and batch of those that stay.  What is read back must
        have the values that were written, ids must be unique and every chunk's document listed; otherwise nothing changes for readers.
        """
        before = self.current()
        name = f"{datetime.now(UTC):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
        self.folder.write("pending.json", {"name": name, "before": before.name if before else None})
        for c in ("batch", "n_chunks"):
            manifest = manifest if c in manifest.columns else manifest.withColumn(c, F.lit(None))
        known = self.manifest().select("document_id", "batch", F.col("n_chunks").alias("_n"))
        counts = self.spark.createDataFrame([], "document_id string, _new bigint")
        if chunks is not None:
            seen = Observation(f"written-{name}")
            chunks.observe(seen, *_bag(chunks)).write.parquet(self.folder.path(f"batch={name}"))
            written = self.spark.read.schema(chunks.schema).parquet(self.folder.path(f"batch={name}"))
            if {k: str(v) for k, v in written.agg(*_bag(written)).first().asDict().items()} != {k: str(v) for k, v in seen.get.items()}:
                raise StoreError("incomplete", "what was read back differs from what was written; the version stays invisible")
            if written.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect():
                raise StoreError("incomplete", "chunk ids repeat; the version stays invisible")
            counts = written.groupBy("document_id").agg(F.count(F.lit(1)).alias("_new"))
            if counts.join(manifest.where("batch IS NULL").select("document_id"), "document_id", "left_anti").limit(1).collect():
                raise StoreError("incomplete", "chunks lack a manifest entry; the version stays invisible")
        rows = manifest.withColumn("batch", F.col("batch").cast("string")).join(known, ["document_id", "batch"], "left").join(counts, "document_id", "left")
        fresh = F.col("batch").isNull()
        rows = rows.select("document_id", "paths", "status", F.when(fresh, F.lit(name)).otherwise(F.col("batch")).alias("batch"), F.when(fresh, F.coalesce("_new", F.lit(0))).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("n_chunks"))
        place = self.folder.path(f"version={name}")
        rows.write.parquet(place)
        stored = self.spark.read.schema(MANIFEST).parquet(place)
        n, distinct, total = stored.agg(F.count(F.lit(1)), F.count_distinct("document_id"), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
        if n != distinct:
            raise StoreError("incomplete", "documents repeat; the version stays invisible")
        batches = sorted(r[0] for r in stored.where("n_chunks > 0").select("batch").distinct().collect())  # as many as commits since the last compaction
        version = Version(name, self.config.fingerprint, revision_of(stored, self.config.fingerprint), total, datetime.now(UTC).isoformat(), batches)
        self.folder.write("current.json", asdict(version))
        self.folder.delete("pending.json")
        return version

    def recover(self) -> str:
        """After a crash: ``clean`` (nothing was under way), ``finished`` (the pointer had been replaced) or ``undone`` (what was written is removed)."""
        pending = self._read("pending.json")
        if pending is None:
            return "clean"
        current = self.current()
        done = current is not None and current.name == pending["name"]
        if not done:
            for part in ("batch", "version"):
                self.folder.delete(f"{part}={pending['name']}")
        self.folder.delete("pending.json")
        return "finished" if done else "undone"

    def compact(self) -> Version:
        """All chunks of the version in one new batch; the batches before can be swept."""
        chunks = self.chunks().drop("batch")
        return self.commit(chunks, self.manifest().drop("batch", "n_chunks"))

    def sweep(self, remove: bool = False) -> list[str]:
        """Versions and batches that the visible version doesn't use; ``remove`` them once no reader is left."""
        current = self.current()
        used = {f"version={current.name}", *(f"batch={b}" for b in current.batches)} if current else set()
        free = [n for n in self.folder.names() if n.split("=")[0] in ("version", "batch") and n not in used]
        for n in free if remove else []:
            self.folder.delete(n)
        return free


def next_version(store: Store, plan: DataFrame, made: DataFrame, failed: DataFrame) -> DataFrame:
    """The manifest after a plan of :func:`marginalia.operators.sync.plan_sync`, for :meth:`Store.commit`.

    ``made`` (document_id) are the documents that have new chunks, ``failed`` (digest) those that couldn't be prepared.  Unchanged, renamed and
    moved documents keep their batch; a replaced document whose successor failed stays as ``stale``; deleted ones go.
    """
    lost = failed.select(F.col("digest").alias("successor")).distinct().withColumn("_failed", F.lit(True))
    steps = plan.join(lost, "successor", "left").withColumn("document_id", F.col("digest"))
    stays = F.col("action").isin("unchanged", "renamed", "moved") | ((F.col("action") == "replaced") & F.coalesce(F.col("_failed"), F.lit(False)))
    batches = store.manifest().select("document_id", "batch", F.col("status").alias("_was"))
    kept = steps.where(stays).join(batches, "document_id").select("document_id", "paths", F.when(F.col("action") == "replaced", "stale").when(F.col("_was") == "stale", "indexed").otherwise(F.col("_was")).alias("status"), "batch")
    new = steps.where(F.col("action").isin("added", "modified", "incomplete")).join(failed.select("digest"), "digest", "left_anti")
    fresh = new.join(made.select("document_id").distinct().withColumn("_made", F.lit(True)), "document_id", "left")
    return kept.unionByName(fresh.select("document_id", "paths", F.when(F.col("_made"), "indexed").otherwise("empty").alias("status"), F.lit(None).cast("string").alias("batch")))
