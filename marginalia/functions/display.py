"""Readable plain text of converted pages, for display only."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings and entries of a bibliography, and a link that trails before one.
_HEADING = r"(?im)^\s*(?:#{1,6}\s*)?(?:\*\*|__)?\s*(?:\d+[.)]?\s*)?(?:references|bibliography|works cited)\s*(?:\*\*|__)?\s*:?\s*$"
_ENTRY = r"(?m)^\s*(?:[-*+]\s*)?\[\d{1,4}\]\s+\p{Lu}"
_INLINE_ENTRY = r"\[\d{1,4}\]\s+[A-Z][\p{L}\p{N}_-]+"
_TRAILING_LINK = r"(?i)\s*(?:retrieved from|doi:)\s*!?\[[^\]]+\]\([^)]*\)\.?\s*$"
# publishers' notes, a DOI on its own, and lines that name authors with their institution but state nothing.
_PUBLISHER = r"(?i)^(?:authors?[’']?\s+contact\s+information\s*:|[∗*†‡]*\s*(?:co[- ]first|corresponding)\s+authors?\s*\.?$|permission to make digital or hard copies\b|©\s*\d{4}\s+copyright held\b)"
_DOI = r"(?i)^https?://(?:dx\.)?doi\.org/\S+$"
_BYLINE = r"^[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ.'’\-]*(?:\s+[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ.'’\-]*){1,6}\s*[∗*†‡\d]*\s*,"
_INSTITUTION = r"(?i)\b(?:university|institute|college|academy|laboratory|research|hospital)\b"
_PROSE = r"(?i)\b(?:we|our|this|these|is|are|was|were|has|have|shows?|findings?|proposes?|compares?|evaluates?|demonstrates?)\b"


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities resolved; the table of names is Python's."""
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def plain_text(text: Column, *, entities: bool = True) -> Column:
    """Without comments, code fences, link targets, tags, emphasis, heading and list marks; white space collapsed. Null gives ''."""
    t = F.coalesce(text, F.lit(""))
    t = unescape(t) if entities else t
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)```[^\n]*\n?(.*?)```", "$1")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\\([\\`*_{}\[\]()#+\-.!<>])", "$1")
    t = F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", "")
    t = F.replace(t, F.lit("`"), F.lit(""))
    t = F.regexp_replace(t, r"(?:\*\*|__|~~)(.+?)(?:\*\*|__|~~)", "$1")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])[*_]([^\n*_]+?)[*_](?![\p{L}\p{N}_])", "$1")
    t = F.regexp_replace(t, r"(?m)^\s*(?:#{1,6}|[-+*>]|\d+[.)])\s+", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def without_bibliography(text: Column) -> Column:
    """The text before a heading of references or the first numbered entry that begins a line; where there's neither, before the first of two or more entries in a line."""
    t = F.coalesce(text, F.lit(""))
    before = F.regexp_replace(F.split(t, _HEADING, 2)[0], r"(?s)" + _ENTRY + r".*$", "")
    inline = F.regexp_count(t, F.lit(_INLINE_ENTRY)) >= 2
    cut = F.when(before != t, before).when(inline, F.regexp_replace(t, r"(?s)" + _INLINE_ENTRY + r".*$", "")).otherwise(t)
    return F.when(cut != t, F.regexp_replace(cut, _TRAILING_LINK, "")).otherwise(t)


def is_byline(plain: Column) -> Column:
    """Names in capitals with an institution and no statement."""
    return plain.rlike(_BYLINE) & plain.rlike(_INSTITUTION) & ~plain.rlike(_PROSE)


def without_publication_notes(text: Column) -> Column:
    """Without paragraphs of publishers and bylines, a DOI right behind one, and bylines above an abstract; entities must be resolved."""
    shown = lambda c: plain_text(c, entities=False)
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n|(?m)(?=^#{1,6}\s)"), lambda p: shown(p) != "")
    noted = F.transform(parts, lambda p: F.struct(p.alias("p"), (shown(p).rlike(_PUBLISHER) | is_byline(shown(p))).alias("note"), shown(p).rlike(_DOI).alias("doi")))
    # A DOI goes only in a run of such paragraphs that a note opened.
    kind = "struct<kept:array<string>,open:boolean>"
    lines = lambda p: F.array_join(F.filter(F.split(p, r"\r\n|\r|\n"), lambda x: ~is_byline(shown(x))), "\n")
    step = lambda s, x: F.when(x["note"] | (s["open"] & x["doi"]), F.struct(s["kept"].alias("kept"), F.lit(True).alias("open"))).otherwise(F.struct(F.concat(s["kept"], F.array(lines(x["p"]))).alias("kept"), F.lit(False).alias("open"))).cast(kind)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("open")).cast(kind)
    return F.array_join(F.aggregate(noted, start, step)["kept"], "\n\n")


def excerpt(text: Column) -> Column:
    """What an evidence card shows: prose only, without bibliography, publishers' notes and marks."""
    return plain_text(without_publication_notes(unescape(without_bibliography(text))), entities=False)


def score_map(columns: list[str]) -> Column:
    """A map of the score and distance columns that aren't null."""
    named = [c for c in columns if c.endswith(("score", "distance"))]
    every = F.map_from_arrays(F.array(*(F.lit(c) for c in named)), F.array(*(F.col(c).cast("double") for c in named)))
    return F.map_filter(every, lambda _, v: v.isNotNull())
