"""A library and its store brought together: plan, preparation of new contents, commit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.sync import VISIBLE, check_deletions, plan_sync
from marginalia.runtime import Scratch
from marginalia.sources.store import Store, Version, next_version

#: (contents to prepare: digest, primary_path) -> (chunks with id, document_id = digest and more; failed digests)
Prepare = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def with_vectors(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, batch: int = 64) -> DataFrame:
    """Adds ``vector`` by a text encoder that ``load`` makes once a worker; texts go in batches, vectors must have the stated length."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            listed = texts.fillna("").tolist()
            found = [v for at in range(0, len(listed), batch) for v in model(listed[at : at + batch])]
            if len(found) != len(listed) or any(len(v) != dimension for v in found):
                raise ValueError(f"the encoder must give one vector of {dimension} numbers for each text")
            yield pd.Series(found)

    return chunks.withColumn("vector", encode("text"))


def synchronise(store: Store, files: DataFrame, prepare: Prepare, *, most_deleted: float = 0.5, force: bool = False) -> tuple[Version, DataFrame]:
    """The version after all of ``files`` (digest, path) are in the store, and the plan that led to it.

    Only contents that are new, or whose stored chunks are incomplete, are prepared.  What fails is left out: its predecessor stays as stale,
    and the next run tries again.  An interrupted commit is undone first.
    """
    store.recover()
    scratch = Scratch(store.spark, "synchronise")
    manifest = store.manifest()
    has = store.current() is not None and store.current().n_chunks > 0
    known = manifest.where(F.col("status").isin(*VISIBLE, "empty")).select(F.col("document_id").alias("digest"), "paths")
    plan = plan_sync(files, known)
    if has:
        broken = store.incomplete().select(F.col("document_id").alias("digest"), F.lit(True).alias("_broken"))
        plan = plan.join(broken, "digest", "left").withColumn("action", F.when(F.col("_broken") & F.col("action").isin("unchanged", "renamed", "moved"), "incomplete").otherwise(F.col("action"))).drop("_broken")
    plan = scratch.write(plan, "plan")
    check_deletions(plan, most_deleted, force)
    wanted = plan.where(F.col("action").isin("added", "modified", "incomplete")).select("digest", "primary_path")
    if wanted.limit(1).collect():
        chunks, failed = prepare(wanted)
        # Preparation is dear: written once, then counted and committed.
        chunks, failed = scratch.write(chunks, "chunks"), scratch.write(failed.select("digest").distinct(), "failed")
        chunks = chunks.join(failed.select(F.col("digest").alias("document_id")), "document_id", "left_anti")
    else:
        chunks, failed = None, store.spark.createDataFrame([], "digest string")
    made = chunks.select("document_id") if chunks is not None else store.spark.createDataFrame([], "document_id string")
    return store.commit(chunks, next_version(store, plan, made, failed)), plan
