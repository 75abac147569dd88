"""The library of files: listing, page texts, safe names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.terms import fold_case

MAX_UPLOAD = 25 * 1024 * 1024
Extractor = Callable[[bytes], list[tuple[int, str]]]


def _files(spark: SparkSession, root: str) -> DataFrame:
    """The reader's columns and ``relative``, the path below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").option("ignoreCorruptFiles", False).load(root)
    base = re.sub(r"^(?:[a-z]+:)?/*", "/", root.rstrip("/") + "/")
    inner = F.regexp_replace(F.col("path"), "^(?:[a-z]+:)?/*", "/")
    return files.withColumn("relative", F.substring(inner, F.lit(len(base) + 1), F.length(inner)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of the files of :func:`scan`, without reading their content."""
    return _files(spark, root).select(F.col("relative").alias("path"), "length", F.col("modificationTime").alias("modified")).orderBy(fold_case(F.col("path")), "path")


def scan(spark: SparkSession, root: str, *, content: bool = False) -> DataFrame:
    """(path, digest, length, modified) of all PDF files under ``root``, in any case of their ending; path is relative to it.

    A file that can't be read fails the scan rather than being left out: a partial listing would delete documents.
    Hidden files (names beginning with ``.`` or ``_``) are not part of the library.
    """
    columns = [F.col("relative").alias("path"), F.sha2("content", 256).alias("digest"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else [])]
    return _files(spark, root).select(*columns).orderBy(fold_case(F.col("path")), "path")


def extract_pages(files: DataFrame, first: Extractor, fallback: Extractor) -> DataFrame:
    """(path, digest, page, text): pages of each file by ``first``, or by ``fallback`` if that fails or finds no text; blank pages drop out.

    ``files`` carries ``content``; one file is one row, so a file is the unit of work.
    """
    schema = pa.schema([("path", pa.string()), ("digest", pa.string()), ("page", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, digest, data in zip(*(batch[c].to_pylist() for c in ("path", "digest", "content"))):
                try:
                    pages = [(n, t) for n, t in first(data) if t and t.strip()]
                except Exception:  # noqa: BLE001 - any converter error means the plain way
                    pages = []
                pages = pages or [(n, t) for n, t in fallback(data) if t and t.strip()]
                if pages:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(pages)), pa.array([digest] * len(pages)), pa.array([n for n, _ in pages], pa.int32()), pa.array([t for _, t in pages])], schema=schema)

    return files.select("path", "digest", "content").mapInArrow(run, "path string, digest string, page int, text string")


def upload_name(raw: str) -> str:
    """A safe file name from a percent-encoded one, or ValueError."""
    try:
        name = unquote(raw, errors="strict")
    except UnicodeDecodeError as e:
        raise ValueError("the name isn't UTF-8") from e
    if not name or len(name.encode()) > 200 or re.search(r"[/\\:\x00-\x1f\x7f]", name) or not name.lower().endswith(".pdf") or not name[:-4].strip(". "):
        raise ValueError(f"{name!r} is no name for a PDF file")
    return name


def resolve(root: str | Path, relative: str) -> Path:
    """A file of the library by its relative path; what leads out of the root is refused."""
    base = Path(root).resolve()
    path = (base / PurePosixPath(relative)).resolve()
    if not path.is_relative_to(base) or not path.is_file() or path.suffix.lower() != ".pdf":
        raise FileNotFoundError(relative)
    return path


def store_upload(root: str | Path, raw_name: str, data: bytes) -> Path:
    """Writes a new PDF file, never over another: a taken name gets `` (n)``."""
    name = upload_name(raw_name)
    if not 0 < len(data) <= MAX_UPLOAD:
        raise ValueError(f"a file must have 1 to {MAX_UPLOAD} bytes")
    if not data.startswith(b"%PDF-"):
        raise ValueError("the content isn't a PDF file")
    for n in range(1000):
        path = Path(root) / (name if n == 0 else f"{name[:-4]} ({n}){name[-4:]}")
        try:
            with path.open("xb") as f:
                f.write(data)
            return path
        except FileExistsError:
            continue
    raise FileExistsError(name)


def delete_file(root: str | Path, relative: str) -> None:
    """Removes the file only; its rows leave the index with the next synchronisation."""
    resolve(root, relative).unlink()
