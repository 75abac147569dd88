"""Command line: search, answers, synchronisation, snapshot changes, evaluation.

Models and converters are named as ``module:function``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.answers import Answer, generate
from marginalia.config import IndexConfig, RetrievalConfig, load
from marginalia.operators.chunks import stored_chunks
from marginalia.operators.evaluation import label_problems, leaked_queries, locator_hits, locator_metrics, paper_coverage, retrieval_metrics
from marginalia.operators.snapshots import manifest_changes
from marginalia.operators.sync import by_content, plan_sync, sync_counts
from marginalia.search import search
from marginalia.sources.labelled import golden_set, write_report
from marginalia.sources.library import scan
from marginalia.sources.prepare import preparation
from marginalia.sources.store import Store
from marginalia.sources.synchronise import synchronise


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    ask = sub.add_parser("search", help="evidence for a question from a chunk table")
    ask.add_argument("question")
    ask.add_argument("--chunks", required=True)
    ask.add_argument("--config", help="TOML file with a [retrieval] section")
    answer = sub.add_parser("ask", help="an answer with checked citations from a store")
    answer.add_argument("question")
    answer.add_argument("--store", required=True)
    answer.add_argument("--backend", required=True, help="module:function of (system, user) -> text")
    answer.add_argument("--paper", help="restrict to the document with this path")
    sync = sub.add_parser("sync", help="bring a store up to date with a library folder")
    sync.add_argument("library")
    sync.add_argument("--store", required=True)
    sync.add_argument("--converter", required=True, help="module:function of bytes -> [(page, text)]")
    sync.add_argument("--most-deleted", type=float, default=0.5)
    sync.add_argument("--force", action="store_true")
    evaluate = sub.add_parser("evaluate", help="search of a store measured against a golden set")
    evaluate.add_argument("golden")
    evaluate.add_argument("--store", required=True)
    evaluate.add_argument("--report", help="JSON file to write")
    plan = sub.add_parser("sync-plan", help="what a library folder changes against a manifest table (digest, paths)")
    plan.add_argument("library")
    plan.add_argument("--manifest", required=True)
    changes = sub.add_parser("changes", help="what changed between the snapshots of a table")
    changes.add_argument("snapshots")
    labels = sub.add_parser("check-labels", help="what keeps labels from being used")
    labels.add_argument("labels")
    return p


def named(what: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = what.partition(":")
    if not function:
        raise ValueError(f"{what!r} isn't module:function")
    return getattr(importlib.import_module(module), function)


def _searchable(store: Store) -> DataFrame:
    """Visible chunks as search rows; the first path is the source."""
    return store.visible_chunks().withColumn("source", F.coalesce(F.try_element_at("paths", F.lit(1)), "source")).withColumn("paper", F.col("document_id"))


def ask(spark: SparkSession, store: Store, question: str, backend: Callable[[str, str], str], paper: str | None = None) -> Answer:
    chunks = _searchable(store)
    scope = None
    if paper is not None:
        owners = [r[0] for r in chunks.where(F.array_contains("paths", paper)).select("document_id").distinct().limit(2).collect()]
        if len(owners) != 1:
            raise ValueError(f"{paper} isn't one indexed document")
        scope = owners[0]
    asked = spark.createDataFrame([(0, question, scope)], "query_id bigint, text string, scope string")
    found = search(asked, chunks, load(RetrievalConfig)).join(chunks.select("id", "title", "document_id"), "id").orderBy("place").collect()
    # A document may have several paths: a question that names one is answered from that one.
    return generate(backend, question, [r.asDict() | ({"source": paper} if paper is not None else {}) for r in found])


def evaluate(spark: SparkSession, store: Store, golden: str) -> dict:
    cases, expected = golden_set(spark, golden)
    numbered = cases.select("case_id", F.row_number().over(W.orderBy("case_id")).alias("query_id"), F.col("question").alias("text"))
    found = search(numbered.select("query_id", "text"), _searchable(store), load(RetrievalConfig))
    hits = found.join(numbered.select("query_id", "case_id"), "query_id").select("case_id", F.col("place").alias("rank"), "id", "source", "page", "text")
    one = retrieval_metrics(cases.select("case_id", "expected", "n_expected"), locator_hits(hits, expected)).first().asDict()
    return {**one, "locators": locator_metrics(expected, hits).first().asDict(), "papers": [r.asDict() for r in paper_coverage(expected, locator_hits(hits, expected)).orderBy("source").collect()]}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("marginalia").getOrCreate()
    if args.command == "search":
        config = load(RetrievalConfig, toml=args.config, section="retrieval")
        question = spark.createDataFrame([(0, args.question)], "query_id bigint, text string")
        for r in search(question, stored_chunks(spark.read.parquet(args.chunks)), config).orderBy("place").collect():
            print(f"[E{r.place}] {r.source}, page {r.page}\n{r.text}\n")
    elif args.command == "ask":
        answer = ask(spark, Store(spark, args.store, load(IndexConfig)), args.question, named(args.backend), args.paper)
        print(answer.text or f"{answer.status}: {answer.reason or ''}")
        print("\n".join(f"[{e.evidence_id}] {e.reference}" for e in answer.evidence if e.evidence_id in answer.check.cited))
    elif args.command == "sync":
        config = load(IndexConfig)
        files = scan(spark, args.library, content=True)
        convert = named(args.converter)
        version, plan = synchronise(Store(spark, args.store, config), files.select("digest", "path"), preparation(files, convert, convert, config), most_deleted=args.most_deleted, force=args.force)
        sync_counts(plan).show(truncate=False)
        print(f"version {version.name}, {version.n_chunks} chunks")
    elif args.command == "evaluate":
        report = evaluate(spark, Store(spark, args.store, load(IndexConfig)), args.golden)
        print(json.dumps(report, indent=1, default=str))
        if args.report:
            write_report(args.report, report)
    elif args.command == "sync-plan":
        manifest = by_content(spark.read.parquet(args.manifest).select("digest", F.explode("paths").alias("path")))
        sync_counts(plan_sync(scan(spark, args.library).select("digest", "path"), manifest)).show(truncate=False)
    elif args.command == "changes":
        manifest_changes(spark.read.parquet(args.snapshots)).groupBy("snapshot_no", "change_kind").count().orderBy("snapshot_no", "change_kind").show(1000)
    else:
        table = spark.read.parquet(args.labels)
        label_problems(table).show(truncate=False)
        print("questions in more than one split:", leaked_queries(table).count())
    return 0


if __name__ == "__main__":
    sys.exit(main())
