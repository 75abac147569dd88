"""Page texts: repeated margins, titles, sections, paragraphs, sentences, passages.

Line and paragraph work stays in the JVM, exploded with positions; only packing
passages, which is greedy, runs in Python, page by page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.passages import Tokenizer, characters, paragraphs, passages, sentences
from marginalia.functions.terms import fold_case
from marginalia.operators.chunks import UNTITLED

PAGE_NUMBER = "<page-number>"


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_title(c: Column) -> Column:
    """Without tags and marks of emphasis, white space collapsed."""
    return _squeeze(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "[*_`#]+", ""))


def margin_signature(line: Column) -> Column:
    """What a header or footer line has in common over pages: numbers as ``#``, page numbers as one mark; null for lines too long, or with too few letters, to be a margin."""
    plain = fold_case(plain_title(line))
    masked = _squeeze(F.regexp_replace(plain, r"\p{Nd}+", "#"))
    letters = F.length(F.regexp_replace(masked, r"[^\p{L}]", ""))
    return F.when(plain == "", None).when(plain.rlike(r"^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$"), F.lit(PAGE_NUMBER)).when((F.length(masked) <= 200) & (letters >= 4), masked)


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: the page's columns but the text, ``line_no`` and ``line``, and its place from the top and bottom among lines that aren't blank."""
    split = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n|\r", "\n"), "\n", -1)
    keep = [c for c in pages.columns if c != text]
    out = pages.select(*keep, F.posexplode(split).alias("line_no", "line"))
    own = [F.col(c) for c in ("document_id", "page")]
    filled = F.trim(F.regexp_replace("line", r"(?U)\s+", " ")) != ""
    from_top = F.sum(filled.cast("int")).over(W.partitionBy(*own).orderBy("line_no"))
    all_ = F.sum(filled.cast("int")).over(W.partitionBy(*own))
    return out.withColumn("_filled", filled).withColumn("from_top", F.when(filled, from_top)).withColumn("from_bottom", F.when(filled, all_ - from_top + 1))


def margin_counts(pages: DataFrame) -> DataFrame:
    """(document_id, place, signature, n_pages, n_all): on how many pages a signature stands among the first two or last two lines."""
    one = lines(pages).where((F.col("from_top") <= 2) | (F.col("from_bottom") <= 2)).withColumn("signature", margin_signature(F.col("line"))).where("signature IS NOT NULL")
    places = F.explode(F.array_compact(F.array(F.when(F.col("from_top") <= 2, F.lit("top")), F.when(F.col("from_bottom") <= 2, F.lit("bottom")))))
    counted = one.select("document_id", "page", "signature", places.alias("place")).distinct().groupBy("document_id", "place", "signature").agg(F.count(F.lit(1)).alias("n_pages"))
    return counted.join(pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_all")), "document_id")


def is_repeated() -> Column:
    return F.col("n_pages") >= F.greatest(F.lit(2), F.ceil(F.col("n_all") * 0.3))


_LOCATOR = r"^(?s:.{0,200}?)(?<![\d:])(?:\*\*)?(\d{1,4}):(\d{1,4})(?:\*\*)?[ \t]+"


def strip_locators(pages: DataFrame) -> DataFrame:
    """Drops what stands before and in journal locators (``volume:page``) whose distance to the page number repeats in the document."""
    head = F.substring(F.col("text"), 1, 200)
    volume = F.nullif(F.regexp_extract(head, _LOCATOR, 1), F.lit(""))
    offset = F.regexp_extract(head, _LOCATOR, 2).try_cast("int") - F.col("page")
    located = pages.withColumn("_volume", volume).withColumn("_offset", F.when(volume.isNotNull(), offset))
    n = F.count(F.when(F.col("_volume").isNotNull(), 1)).over(W.partitionBy("document_id", "_volume", "_offset"))
    all_ = F.count(F.lit(1)).over(W.partitionBy("document_id"))
    located = located.withColumn("_repeats", F.col("_volume").isNotNull() & (n >= F.greatest(F.lit(2), F.ceil(all_ * 0.3))))
    body = F.regexp_replace(F.col("text"), _LOCATOR, "")
    volumes = F.collect_set(F.when(F.col("_repeats"), F.col("_volume"))).over(W.partitionBy("document_id"))
    first = F.col("page") == F.min("page").over(W.partitionBy("document_id"))
    bold = F.regexp_extract(F.col("text"), r"^\s*\*\*(\d{1,4})(?:\*\*)?[ \t]+", 1)
    opened = F.when(first & F.array_contains(volumes, bold), F.regexp_replace(F.col("text"), r"^\s*\*\*\d{1,4}(?:\*\*)?[ \t]+", "")).otherwise(F.col("text"))
    return located.withColumn("text", F.when(F.col("_repeats"), body).otherwise(opened)).drop("_volume", "_offset", "_repeats")


def strip_running_title(text: Column, title: Column) -> Column:
    """Without the document's title, if it has four words or more, at the beginning of a page, with marks and a page number behind it."""
    words = F.regexp_extract_all(plain_title(F.coalesce(title, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    pattern = F.concat(F.lit(r"(?iu)^\s*(?:[#*_`]+\s*)*"), F.array_join(words, r"[^\p{L}\p{N}]+"), F.lit(r"(?:\s*[*_`#]+)*[ \t]*(?:\d+(?::\d+)?)?[ \t]*"))
    return F.when(F.size(words) >= 4, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


def strip_margins(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(document_id, page, text) without header and footer lines that repeat over the document's pages; pages left empty drop out.

    ``pages`` has one row a document and page.  Null texts count as empty.  With ``titles`` (document_id, title) running titles go first.
    """
    texts = pages.select("document_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    if titles is not None:
        texts = texts.join(titles.select("document_id", "title"), "document_id", "left").select("document_id", "page", strip_running_title(F.col("text"), F.col("title")).alias("text"))
    found = strip_locators(texts)
    repeated = margin_counts(found).where(is_repeated()).select("document_id", "place", "signature")
    numbered = lines(found).withColumn("signature", F.when((F.col("from_top") <= 2) | (F.col("from_bottom") <= 2), margin_signature(F.col("line"))))
    top = repeated.where("place = 'top'").select("document_id", "signature", F.lit(True).alias("_top"))
    bottom = repeated.where("place = 'bottom'").select("document_id", "signature", F.lit(True).alias("_bottom"))
    marked = numbered.join(top, ["document_id", "signature"], "left").join(bottom, ["document_id", "signature"], "left")
    gone = F.coalesce((F.col("_top") & (F.col("from_top") <= 2)) | (F.col("_bottom") & (F.col("from_bottom") <= 2)), F.lit(False))
    text = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), r"(?U)^\s+|\s+$", "")
    return marked.where(~gone).groupBy("document_id", "page").agg(text.alias("text")).where("text <> ''")


def guess_title(text: Column, stem: Column) -> Column:
    """The first level-1 heading, else the first line of more than 15 characters that isn't all capitals, else the file's name."""
    split = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    heading = F.filter(split, lambda x: x.rlike(r"^#\s+\S"))
    useful = F.filter(split, lambda x: (F.length(x) > 15) & ~((F.upper(x) == x) & (F.lower(x) != x)))
    return F.when(F.size(heading) > 0, plain_title(F.regexp_replace(heading[0], r"^#\s+|\s*#*\s*$", ""))).when(F.size(useful) > 0, plain_title(useful[0])).otherwise(stem)


def paragraph_rows(pages: DataFrame, key: str) -> DataFrame:
    """One row a paragraph: key, ``paragraph`` from 0, ``start``, ``end`` (code points), ``heading``, ``is_heading``.

    Null and blank texts have none.
    """
    schema = pa.schema([("key", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("heading", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"].to_pylist(), b["text"].to_pylist()):
                page = paragraphs(t or "")
                opens = [a != b for a, b in zip(page.section_id, [0, *page.section_id])]
                rows += [(k, i, a, b, name if new else None) for i, (a, b, name, new) in enumerate(zip(page.start, page.end, page.section, opens))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    out = pages.select(F.col(key).alias("key"), "text").mapInArrow(run, "key bigint, paragraph int, start int, end int, heading string")
    return out.withColumnRenamed("key", key)


def carry_sections(rows: DataFrame, document: str = "document_id", order: tuple[str, ...] = ("page", "paragraph")) -> DataFrame:
    """Adds ``section`` and ``section_id``: each heading begins a section that lasts, over pages, to the next."""
    so_far = W.partitionBy(document).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("section_id", F.sum(F.col("heading").isNotNull().cast("int")).over(so_far)).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(so_far), F.lit(UNTITLED)))


def sentence_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ``sentence`` from 0, ``start``, ``end``); blank texts have none."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in sentences(t) if b > a] if t else [])

    return df.select(key, F.posexplode(spans.asNondeterministic()(F.col(text))).alias("sentence", "_s")).select(key, "sentence", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))


def passage_rows(pages: DataFrame, key: str, size: int, overlap: int, tokens: Tokenizer = characters) -> DataFrame:
    """(key, ``passage`` from 0, ``start``, ``end``, ``section``, ``section_id``, ``paragraph_start``, ``paragraph_end``) of every page.

    Sizes are in the tokenizer's tokens; by default a token is a character.
    """
    fields = "passage:int,start:int,end:int,section:string,section_id:int,paragraph_start:int,paragraph_end:int"

    @F.pandas_udf(f"array<struct<{fields}>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"passage": i, **p.__dict__} for i, p in enumerate(passages(t, paragraphs(t), size, overlap, tokens))] if t and t.strip() else [])

    return pages.select(key, F.explode(cut.asNondeterministic()(F.col("text"))).alias("_p")).select(key, "_p.*")
