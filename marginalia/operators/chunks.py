"""The stored chunks as a relation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import Scratch

SENT_KEYS = 2_000_000  # hashes of repeated keys that are sent to every task; beyond, whole rows are shuffled

UNTITLED = "Untitled section"


def first_said(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def paper_key(document_id: Column, file_hash: Column, source: Column, chunk_id: Column) -> Column:
    return first_said(document_id, file_hash, source, chunk_id)


def latest_by(df: DataFrame, key: str, version: str = "loaded_at") -> DataFrame:
    """One row a key: the one with the greatest version, null lowest; among equals the greatest row, the same on every run. Null keys are dropped.

    Aggregated before the shuffle, so a key delivered very often isn't gathered in one task.
    Columns that can't be ordered (maps) are compared by their JSON.
    """
    order = [F.col(version), *(F.to_json(F.col(f.name)) if f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema.fields if f.name not in (key, version))]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*").select(*df.columns)


def latest_of_few(df: DataFrame, key: str, version: str = "loaded_at") -> DataFrame:
    """The rows of :func:`latest_by`, for tables where few keys come again: only the rows of those are shuffled, of the others a hash."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_key", F.xxhash64(key))
    again = Scratch(df.sparkSession, "chunks").write(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"), "repeated")
    if again.count() > SENT_KEYS:
        return latest_by(df, key, version)
    once = rows.join(F.broadcast(again), "_key", "left_anti").select(*df.columns)
    return once.unionByName(latest_by(rows.join(F.broadcast(again), "_key", "left_semi").select(*df.columns), key, version))


def stored_chunks(df: DataFrame, latest: Callable[[DataFrame, str], DataFrame] = latest_by) -> DataFrame:
    """Search rows of the chunk table: the latest row of each chunk id with its paper key and defaults."""
    return latest(df, "chunk_id").select(
        F.col("chunk_id").alias("id"),
        "document_id",
        "file_hash",
        "source",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("section", F.lit(UNTITLED)).alias("section"),
        "section_id",
        "page",
        "chunk_index",
        "paragraph_start",
        "paragraph_end",
        "character_start",
        "character_end",
        F.coalesce("text", F.lit("")).alias("text"),
        paper_key(F.col("document_id"), F.col("file_hash"), F.col("source"), F.col("chunk_id")).alias("paper"),
    )


def chunk_position(id_: Column, page: Column, index: Column) -> Column:
    """(page, index) of a chunk, from its columns or else from its id; null if the id names another page."""
    pattern = r"(?i)^[0-9a-f]{16,64}-(\d+)-(\d+)(?:-[0-9a-f]{16})?$"
    id_page = F.regexp_extract(id_, pattern, 1).try_cast("int")
    id_index = F.regexp_extract(id_, pattern, 2).try_cast("int")
    known = F.when(page.isNotNull() & index.isNotNull(), F.struct(page.cast("int").alias("page"), index.cast("int").alias("index")))
    return F.coalesce(known, F.when(id_page == page, F.struct(id_page.alias("page"), id_index.alias("index"))))
