"""Acronyms and what they stand for, as the texts themselves define them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a definition is written, in either order, and small words that give no initial.
_ACRONYM_FIRST = r"\b([A-Z][A-Z-]{1,9})\s*\([^()\n]{3,100}\)"
_PHRASE_FIRST = r"[^()\n.!?;:]{3,100}\s*\([A-Z][A-Z-]{1,9}\)"
_DEFINITION = rf"({_ACRONYM_FIRST}|{_PHRASE_FIRST})"
_SMALL = ("of", "from", "and", "the", "for", "to", "in")


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lower(F.substring(w, 1, 1))), "")


def definitions(records: DataFrame) -> DataFrame:
    """(``acronym``, ``key``, ``phrase``, ``paper``): each spelled-out form of an acronym in each paper that defines it.

    ``records``: paper, text, title.  "Phrase (ABC)" and "ABC (phrase)" count where the words' initials, with or without those of small
    words, are the acronym's letters; before a bracket, the shortest such end of the words.  Phrases with digits don't count.
    """
    text = F.concat_ws("\n", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")))
    found = records.select("paper", F.explode(F.regexp_extract_all(text, F.lit(_DEFINITION), F.lit(1))).alias("d"))
    first = F.col("d").rlike(f"^{_ACRONYM_FIRST}$")
    acronym = F.when(first, F.regexp_extract("d", r"^([A-Z-]+)", 1)).otherwise(F.regexp_extract("d", r"\(([A-Z-]+)\)$", 1))
    raw = F.when(first, F.regexp_extract("d", r"\(([^()]*)\)$", 1)).otherwise(F.regexp_replace("d", r"\s*\([A-Z-]+\)$", ""))
    parts = found.select("paper", first.alias("first"), acronym.alias("acronym"), raw.alias("raw")).where(~F.col("raw").rlike("[0-9]"))
    parts = parts.withColumn("words", F.regexp_extract_all("raw", F.lit("([A-Za-z]+)"), F.lit(1))).withColumn("letters", F.lower(F.replace("acronym", F.lit("-"), F.lit(""))))
    n, all_ = F.length("letters"), F.size("words")
    ends = F.when(all_ >= n, F.transform(F.sequence(n, F.least(all_, 2 * n)), lambda k: F.slice("words", all_ - k + 1, k))).otherwise(F.array().cast("array<array<string>>"))
    options = F.when(F.col("first"), F.array("words")).otherwise(ends)
    fits = F.filter(options, lambda w: (_initials(w) == F.col("letters")) | (_initials(F.filter(w, lambda x: ~F.lower(x).isin(*_SMALL))) == F.col("letters")))
    phrase = F.array_join(F.get(fits, F.lit(0)), " ")
    return parts.where((all_ > 0) & (F.size(fits) > 0)).select("acronym", F.lower(phrase).alias("key"), phrase.alias("phrase"), "paper").distinct()


def terminology(defined: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(``acronym``, ``phrase``): acronyms with one meaning; with ``scopes`` (query_id, paper) one for each query, among its papers only."""
    by = [] if scopes is None else ["query_id"]
    rows = defined if scopes is None else defined.join(scopes, "paper")
    meanings = rows.groupBy(*by, "acronym", "key").agg(F.min("phrase").alias("phrase"))
    return meanings.groupBy(*by, "acronym").agg(F.count(F.lit(1)).alias("_n"), F.min("phrase").alias("phrase")).where("_n = 1").drop("_n")
