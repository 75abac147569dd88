"""Retrieval metrics, threshold analysis and checks of labelled sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("relevant", "topical_negative", "out_of_corpus")


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded share; null where the whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def locator_hits(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Hits (case_id, rank, id, source, page, text) with ``matched``: whether an expected locator has their source and page, and id and contained text where it states them."""
    want = expected.select("case_id", "source", "page", F.col("id").alias("_id"), "text_contains").distinct()
    joined = hits.alias("h").join(want.alias("w"), (F.col("h.case_id") == F.col("w.case_id")) & (F.col("h.source") == F.col("w.source")) & F.col("h.page").eqNullSafe(F.col("w.page")), "left")
    fits = F.col("w.case_id").isNotNull() & (F.col("_id").isNull() | (F.col("h.id") == F.col("_id"))) & (F.col("text_contains").isNull() | F.contains(F.col("h.text"), F.col("text_contains")))
    return joined.groupBy("h.case_id", "h.rank", "h.id", "h.source").agg(F.max(F.coalesce(fits, F.lit(False))).alias("matched"))


def retrieval_metrics(cases: DataFrame, marked: DataFrame) -> DataFrame:
    """One row: cases with expectations, recall, mean reciprocal rank, share of unmatched hits, and what negative cases still returned.

    ``cases``: case_id, expected (answered or abstained), n_expected.
    """
    per = marked.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_hits"), F.sum(F.col("matched").cast("int")).alias("n_matched"), F.min(F.when(F.col("matched"), F.col("rank"))).alias("first"))
    c = cases.join(per, "case_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0))).withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    asked, negative = F.col("n_expected") > 0, F.col("expected") == "abstained"
    n = F.count(F.when(asked, 1))
    return c.agg(
        n.alias("retrieval_cases"),
        rate(F.count(F.when(asked & (F.col("n_matched") > 0), 1)), n).alias("recall"),
        F.round(F.avg(F.when(asked, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)))), 4).alias("mrr"),
        rate(F.sum(F.when(asked, F.col("n_hits") - F.col("n_matched")).otherwise(0)), F.sum(F.when(asked, F.col("n_hits")).otherwise(0))).alias("unmatched_fraction"),
        F.count(F.when(negative & (F.col("n_hits") > 0), 1)).alias("negative_cases_with_evidence"),
        F.coalesce(F.sum(F.when(negative, F.col("n_hits")).otherwise(0)), F.lit(0)).alias("negative_evidence_blocks"),
    )


def paper_coverage(expected: DataFrame, marked: DataFrame, key: str = "source") -> DataFrame:
    """(key, expected_cases, hits, recall): a case counts for a source only if a hit from that source matched."""
    want = expected.select("case_id", key).distinct()
    got = marked.where("matched").select("case_id", key).distinct().withColumn("_hit", F.lit(1))
    return want.join(got, ["case_id", key], "left").groupBy(key).agg(F.count(F.lit(1)).alias("expected_cases"), F.count("_hit").alias("hits")).withColumn("recall", rate(F.col("hits"), F.col("expected_cases")))


def threshold_metrics(scored: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, threshold, tp, fp, fn, tn, precision, recall, false_rejection_rate, false_acceptance_rate); accepted at score >= threshold.

    Rows without a label or with a null or NaN score don't count.  One pass: each row meets the few thresholds by explode.
    """
    by = by or []
    judged = scored.where(F.col("relevant").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    each = judged.select(*by, "relevant", "score", F.explode(F.array(*(F.lit(float(t)) for t in sorted(set(thresholds))))).alias("threshold"))
    yes = F.col("score") >= F.col("threshold")
    n = lambda c: F.count(F.when(c, 1))
    out = each.groupBy(*by, "threshold").agg(n(yes & F.col("relevant")).alias("tp"), n(yes & ~F.col("relevant")).alias("fp"), n(~yes & F.col("relevant")).alias("fn"), n(~yes & ~F.col("relevant")).alias("tn"))
    return (
        out.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"), 6))
        .withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn"), 6))
        .withColumn("false_rejection_rate", rate(F.col("fn"), F.col("tp") + F.col("fn"), 6))
        .withColumn("false_acceptance_rate", rate(F.col("fp"), F.col("fp") + F.col("tn"), 6))
    )


def label_problems(labels: DataFrame) -> DataFrame:
    """(problem, n): what keeps labels from being used for calibration.

    ``labels``: query, passage, split, kind, relevant, annotator.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    field = blank(F.col("annotator")) | blank(F.col("query")) | blank(F.col("passage")) | F.col("relevant").isNull() | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    disagrees = F.coalesce(F.col("relevant") != (F.col("kind") == "relevant"), F.lit(False))
    rows = labels.agg(F.count(F.when(field, 1)).alias("missing_field"), F.count(F.when(disagrees, 1)).alias("label_and_kind_disagree"))
    repeated = labels.where("query IS NOT NULL AND passage IS NOT NULL").groupBy("query", "passage").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_label"))
    one = rows.crossJoin(repeated)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in one.columns))).alias("p")).select("p.*")


def leaked_queries(labels: DataFrame, split: str = "split", query: str = "query") -> DataFrame:
    """(question, n_splits): questions, but for case and white space, found in more than one split."""
    q = F.trim(F.regexp_replace(F.lower(F.col(query)), r"(?U)\s+", " "))
    return labels.where(F.col(split).isNotNull()).withColumn("question", q).where("question <> ''").groupBy("question").agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def kinds_per_split(labels: DataFrame) -> DataFrame:
    """(split, kind): kinds of which a split that is used has no label; calibration needs all three in both."""
    have = labels.where("split IS NOT NULL AND kind IS NOT NULL").select("split", "kind").distinct()
    wanted = have.select("split").distinct().withColumn("kind", F.explode(F.array(*(F.lit(k) for k in KINDS))))
    return wanted.join(have, ["split", "kind"], "left_anti")


def locator_metrics(expected: DataFrame, hits: DataFrame, k: int | None = None) -> DataFrame:
    """One row over anchors: locator precision and recall, the share of cases with any hit on an expected page, and their mean reciprocal rank.

    ``expected``: case_id, source, page, id, text_contains; ``hits``: case_id, rank, id, source, page, text, of which the first ``k`` count.
    """
    hits = hits if k is None else hits.where(F.col("rank") <= k)
    marked = locator_hits(hits, expected)
    precision = marked.agg(rate(F.count(F.when(F.col("matched"), 1)), F.count(F.lit(1))).alias("locator_precision"))
    h, want = hits.alias("h"), expected.alias("w")
    fits = (F.col("w.id").isNull() | (F.col("h.id") == F.col("w.id"))) & (F.col("text_contains").isNull() | F.contains(F.col("h.text"), F.col("text_contains")))
    met = want.join(h, (F.col("w.case_id") == F.col("h.case_id")) & (F.col("w.source") == F.col("h.source")) & F.col("w.page").eqNullSafe(F.col("h.page")) & fits, "left_semi")
    recall = expected.agg(F.count(F.lit(1)).alias("_n")).crossJoin(met.agg(F.count(F.lit(1)).alias("_met"))).select(rate(F.col("_met"), F.col("_n")).alias("locator_recall"))
    best = marked.where("matched").groupBy("case_id").agg(F.min("rank").alias("first"))
    cases = expected.select("case_id").distinct().join(best, "case_id", "left")
    pages = cases.agg(rate(F.count("first"), F.count(F.lit(1))).alias("page_recall"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 4).alias("mrr"))
    return precision.crossJoin(recall).crossJoin(pages)  # one row each


def dimension_coverage(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(source, dimension, expected, retrieved, recall): expected locators with a dimension, and those that some hit of their case meets."""
    want = expected.where("dimension IS NOT NULL")
    at = hits.select("case_id", "source", "page").distinct().withColumn("_met", F.lit(1))
    met = want.join(at.withColumnRenamed("page", "_page"), ["case_id", "source"], "left").withColumn("_met", F.when(F.col("page").eqNullSafe(F.col("_page")), F.col("_met")))
    each = met.groupBy("case_id", "source", "page", "dimension").agg(F.max("_met").alias("_met"))
    out = each.groupBy("source", "dimension").agg(F.count(F.lit(1)).alias("expected"), F.count("_met").alias("retrieved"))
    return out.withColumn("recall", rate(F.col("retrieved"), F.col("expected")))


def generation_metrics(cases: DataFrame, cited: DataFrame, expected: DataFrame) -> DataFrame:
    """One row on generated answers.

    ``cases``: case_id, expected and actual (answered, abstained or validation_failed; null where generation failed), references_valid, support,
    model_calls, recovery_rounds, recovery_success.  ``cited``: case_id, source, page of the evidence of answered cases; ``expected`` as for
    :func:`locator_hits`.
    """
    n = lambda c: F.count(F.when(c, 1))
    wants, declines = F.col("expected") == "answered", F.col("expected") == "abstained"
    answered = F.coalesce(F.col("actual") == "answered", F.lit(False))
    right = F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    valid = answered & F.coalesce("references_valid", F.lit(False))
    hits = cited.withColumn("rank", F.monotonically_increasing_id()).withColumn("id", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))
    marked = locator_hits(hits, expected).agg(rate(n(F.col("matched")), F.count(F.lit(1))).alias("citation_locator_precision"))
    row = cases.agg(
        F.count(F.lit(1)).alias("generation_cases"), n(F.col("actual").isNull()).alias("generation_failures"), rate(n(right), F.count(F.lit(1))).alias("outcome_accuracy"),
        rate(n(wants & valid & F.coalesce(F.col("support") == "passed", F.lit(False))), n(wants)).alias("supported_answer_rate"),
        n(wants & F.coalesce(F.col("actual") == "abstained", F.lit(False))).alias("false_abstentions"), n(declines & answered).alias("false_answers"),
        rate(n(declines & right), n(declines)).alias("abstention_correctness"), rate(n(valid), n(wants)).alias("citation_valid_answer_rate"),
        F.coalesce(F.sum("model_calls"), F.lit(0)).alias("model_calls"), F.coalesce(F.sum("recovery_rounds"), F.lit(0)).alias("recovery_attempts"),
        rate(F.count(F.when(F.col("recovery_success"), 1)), F.coalesce(F.sum("recovery_rounds"), F.lit(0))).alias("recovery_success_rate"),
    )
    return row.crossJoin(marked)  # one row each


# --- calibration -------------------------------------------------------------------------------


def score_contract(model: str, revision: str | None, transform: str, activation: str) -> dict:
    """What a reranker's scores mean: thresholds hold only for scores with the same model, revision and scale."""
    if transform not in ("model-default", "raw", "sigmoid"):
        raise ValueError("the transform must be model-default, raw or sigmoid")
    effective = activation if transform == "model-default" else transform
    bounded = effective.lower() == "sigmoid"
    scale = "[0,1]" if bounded else "unbounded logits" if transform == "raw" else "model-defined"
    return {"model": model, "revision": revision, "transformation": transform, "effective_activation": effective, "score_scale": scale, "score_is_probability": False}


def checked_threshold(contract: dict, threshold: float) -> float:
    if not -float("inf") < threshold < float("inf"):
        raise ValueError("the threshold must be finite")
    if contract["effective_activation"].lower() == "sigmoid" and not 0 <= threshold <= 1:
        raise ValueError("thresholds of sigmoid scores lie between 0 and 1")
    return threshold


def effective_threshold(contract: dict, baseline: float, calibration: dict | None = None) -> float:
    """The baseline, or the threshold a calibration selected, if that was made for the same scores, by people, and evaluated on both splits."""
    if calibration is None:
        return checked_threshold(contract, baseline)
    if calibration.get("status") != "human-reviewed" or not calibration.get("held_out"):
        raise ValueError("a calibration needs human-reviewed labels and held-out results")
    differing = [k for k in ("model", "revision", "transformation", "effective_activation") if calibration.get("score_contract", {}).get(k) != contract[k]]
    if differing or contract["revision"] is None:
        raise ValueError(f"the calibration is for other scores: {', '.join(differing) or 'the revision is unknown'}")
    chosen = float(calibration["selected_threshold"])
    if any(chosen not in [r["threshold"] for r in calibration[split]] for split in ("calibration", "held_out")):
        raise ValueError("the selected threshold wasn't evaluated")
    return checked_threshold(contract, chosen)


def calibrate(labels: DataFrame, thresholds: list[float], selected: float, score: Callable[[Column, Column], Column], contract: dict, snapshot: str | None = None) -> dict:
    """A calibration record: all thresholds measured on both splits; the selected one is the operator's choice, never derived from held-out labels.

    Labels that can't be used (:func:`label_problems`, a question in both splits, a kind missing in a split, a score that isn't finite) are an error.
    """
    if selected not in [float(t) for t in thresholds]:
        raise ValueError("the selected threshold must be among the candidates")
    labels = labels.where(F.col("split").isin("calibration", "held_out"))
    bad = {r["problem"]: r["n"] for r in label_problems(labels).where("n > 0").collect()}
    if bad:
        raise ValueError(f"labels can't be used: {bad}")
    if leaked_queries(labels).limit(1).collect():
        raise ValueError("questions in both splits")
    if labels.select("split").distinct().count() < 2 or kinds_per_split(labels).limit(1).collect():
        raise ValueError("both splits need labels of every kind")
    scored = labels.withColumn("score", score(F.col("query"), F.col("passage")))
    if scored.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).limit(1).collect():
        raise ValueError("a score isn't finite")
    measured = threshold_metrics(scored, thresholds, ["split"]).orderBy("threshold").collect()  # a row a split and threshold
    rows = {split: [{k: v for k, v in r.asDict().items() if k != "split"} for r in measured if r["split"] == split] for split in ("calibration", "held_out")}
    return {"status": "human-reviewed", "score_contract": contract, "snapshot_revision": snapshot, "selected_threshold": checked_threshold(contract, selected), **rows}
