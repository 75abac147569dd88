"""From files to the chunks a store keeps: pages, margins, passages, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import IndexConfig
from marginalia.functions.passages import Tokenizer, characters
from marginalia.operators.pages import guess_title, passage_rows, strip_margins
from marginalia.sources.library import Extractor, extract_pages
from marginalia.sources.synchronise import Prepare, with_vectors


def chunk_rows(pages: DataFrame, config: IndexConfig, tokens: Tokenizer = characters) -> DataFrame:
    """(id ``<document>-<page>-<index>``, document_id, source, title, page, chunk_index, section, section_id, paragraph_start, paragraph_end, character_start, character_end, text).

    ``pages``: document_id, source, page, text.  The title is guessed from the first page; running titles and repeated margins go.
    """
    first = pages.groupBy("document_id").agg(F.min_by(F.struct("text", "source"), "page").alias("p"))
    titles = first.select("document_id", F.col("p.source").alias("source"), guess_title(F.col("p.text"), F.regexp_replace("p.source", r"^.*/|\.[^./]*$", "")).alias("title"))
    clean = strip_margins(pages, titles).withColumn("key", F.struct("document_id", "page"))
    cut = passage_rows(clean, "key", config.chunk_size, config.chunk_overlap, tokens)
    rows = cut.join(clean.select("key", F.col("text").alias("_page")), "key").join(titles, F.col("key.document_id") == F.col("document_id"))
    return rows.select(
        F.concat_ws("-", "document_id", F.col("key.page").cast("string"), F.col("passage").cast("string")).alias("id"), "document_id", "source", "title", F.col("key.page").alias("page"), F.col("passage").alias("chunk_index"), "section", "section_id",
        "paragraph_start", "paragraph_end", F.col("start").alias("character_start"), F.col("end").alias("character_end"), F.substring(F.col("_page"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"),
    )


def preparation(files: DataFrame, convert: Extractor, fallback: Extractor, config: IndexConfig, *, tokens: Tokenizer = characters, load_encoder: Callable | None = None) -> Prepare:
    """How :func:`synchronise` prepares contents: ``files`` (path, digest, content) through converters, chunking and, if there's an encoder, vectors.

    A content whose every conversion fails or finds nothing has no chunks and so becomes ``empty``.
    """

    def prepare(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = files.join(wanted.select("digest", F.col("primary_path").alias("path")), ["digest", "path"])
        pages = extract_pages(own, convert, fallback).select(F.col("digest").alias("document_id"), F.col("path").alias("source"), "page", "text")
        chunks = chunk_rows(pages, config, tokens)
        if load_encoder is not None:
            chunks = with_vectors(chunks, load_encoder, config.embedding_dimension)
        return chunks, wanted.sparkSession.createDataFrame([], "digest string")

    return prepare
