import json

import pytest
from pyspark.sql import functions as F

from marginalia.config import IndexConfig, RetrievalConfig, load
from marginalia.operators.questions import aliases, corrections, instruction, needs_scope, variants
from marginalia.sources.labelled import golden_set, relevance_labels, write_report
from marginalia.sources.library import delete_file, extract_pages, listing, resolve, scan, store_upload, upload_name
from marginalia.operators.sync import legacy_owners
from marginalia.sources.store import Store, StoreError
from marginalia.sources.synchronise import synchronise, with_vectors
from marginalia.streaming.library_stream import new_files, run_available

PDF = b"%PDF-1.4 page one\fpage two"


def test_scan_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "B file.pdf").write_bytes(PDF)
    (tmp_path / "sub" / "a.PDF").write_bytes(b"%PDF FAIL")
    (tmp_path / "x.txt").write_bytes(b"no")
    files = scan(spark, str(tmp_path), content=True)
    assert [r.path for r in files.collect()] == ["B file.pdf", "sub/a.PDF"]
    listed = listing(spark, str(tmp_path))
    assert [(r.path, r.length) for r in listed.collect()] == [("B file.pdf", len(PDF)), ("sub/a.PDF", 9)] and "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]

    def split_pages(data):  # inside, so it travels to the workers by value
        if b"FAIL" in data:
            raise ValueError("converter")
        return [(i, t) for i, t in enumerate(data.decode().split("\f"), 1)]

    pages = extract_pages(files, split_pages, lambda d: [(1, d.decode()), (2, "  ")])
    assert sorted((r.path, r.page) for r in pages.collect()) == [("B file.pdf", 1), ("B file.pdf", 2), ("sub/a.PDF", 1)]


def test_names_and_uploads(tmp_path):
    for bad in ("", "a.txt", "a%2Fb.pdf", "..pdf", "%ff.pdf", "a%00.pdf", "x" * 300 + ".pdf"):
        with pytest.raises(ValueError):
            upload_name(bad)
    assert upload_name("a%20b.PDF") == "a b.PDF"
    assert store_upload(tmp_path, "a.pdf", PDF).name == "a.pdf" and store_upload(tmp_path, "a.pdf", PDF).name == "a (1).pdf"
    for data in (b"", b"text"):
        with pytest.raises(ValueError):
            store_upload(tmp_path, "b.pdf", data)
    with pytest.raises(FileNotFoundError):
        resolve(tmp_path, "../a.pdf")
    delete_file(tmp_path, "a (1).pdf")
    with pytest.raises(FileNotFoundError):
        resolve(tmp_path, "a (1).pdf")


def test_config(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text("chunk_size = 200\nchunk_overlap = 20\n")
    c = load(IndexConfig, toml=file, environ={"MARGINALIA_CHUNK_SIZE": "100", "MARGINALIA_NORMALIZE_EMBEDDINGS": "no"}, chunk_overlap=5)
    assert (c.chunk_size, c.chunk_overlap, c.normalize_embeddings) == (100, 5, False) and c.fingerprint != IndexConfig().fingerprint
    for kwargs in ({"chunk_overlap": 300}, {"embedding_model": " "}, {"unknown": 1}, {"chunking_strategy": "x"}, {"chunk_size": "many"}):
        with pytest.raises(ValueError):
            load(IndexConfig, environ={}, **kwargs)
    for kwargs in ({"mode": "x"}, {"rrf_k": 0}, {"mmr_lambda": 2.0}, {"reranker_min_score": float("inf")}, {"mode": "dense", "paper_cap_policy": "task-aware"}):
        with pytest.raises(ValueError):
            RetrievalConfig(**kwargs)


def tables(spark, docs):
    chunks = spark.createDataFrame([(f"{d}-1", d, t) for d, t in docs], "id string, document_id string, text string")
    manifest = spark.createDataFrame([(d, [f"{d}.pdf"], "indexed") for d, _ in docs], "document_id string, paths array<string>, status string")
    return chunks, manifest


def test_store_commits_are_atomic(spark, tmp_path):
    store = Store(spark, tmp_path, IndexConfig())
    assert store.current() is None and store.recover() == "clean"
    first = store.commit(*tables(spark, [("a", "x"), ("b", "y")]))
    assert store.current() == first and {r.id for r in store.visible_chunks().collect()} == {"a-1", "b-1"} and store.get(["a-1"]).count() == 1
    chunks, manifest = tables(spark, [("c", "z")])
    for bad in ((chunks.unionByName(chunks), manifest), (chunks, tables(spark, [("d", "z")])[1]), (chunks, manifest.unionByName(manifest))):
        with pytest.raises(StoreError):
            store.commit(*bad)  # repeated ids, no entry, repeated documents: readers keep the version before
        assert store.current() == first and store.recover() == "undone" and store.sweep() == []
    with pytest.raises(StoreError) as e:
        Store(spark, tmp_path, IndexConfig(chunk_size=100)).current()
    assert e.value.status == "mismatch"
    second = store.commit(*tables(spark, [("a", "x"), ("b", "y")]))
    assert second.revision == first.revision and second.name != first.name and len(store.sweep()) == 2
    third = store.commit(*tables(spark, [("a", "x"), ("c", "y")]))
    assert third.revision != first.revision and len(store.sweep(remove=True)) == 4 and store.sweep() == []
    store.folder.write("pending.json", {"name": third.name})
    assert store.recover() == "finished" and store.visible_chunks().count() == 2
    (tmp_path / "current.json").write_text("{")
    with pytest.raises(StoreError):
        store.current()
    (tmp_path / "current.json").unlink()
    with pytest.raises(StoreError) as e:
        store.current()
    assert e.value.status == "legacy"


def test_small_files_on_any_file_system(spark, tmp_path):
    from marginalia.sources.folder import Folder

    folder = Folder(spark, f"file://{tmp_path}/sub")
    folder.local = None  # as for a file system that Python doesn't see
    assert folder.names() == [] and folder.read("a.json") is None
    for n in (1, 2):
        folder.write("a.json", {"n": n})
    assert json.loads(folder.read("a.json")) == {"n": 2} and [n for n in folder.names() if not n.startswith(".")] == ["a.json"]
    folder.delete("a.json")
    assert folder.read("a.json") is None


def test_read_back_compares_values(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    store = Store(spark, tmp_path, IndexConfig())
    read = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *p: read(self, *p).replace("x", "other", "text") if "batch=" in p[0] else read(self, *p))
    with pytest.raises(StoreError, match="differs"):
        store.commit(*tables(spark, [("a", "x")]))
    assert store.current() is None


def test_synchronise(spark, tmp_path):
    store = Store(spark, tmp_path, IndexConfig())
    asked = []

    def prepare(wanted):
        rows = [(r.digest, r.primary_path) for r in wanted.collect()]
        asked.append(sorted(d for d, _ in rows))
        good = [(f"{d}-1-{i}", d, f"text {i} of {d}") for d, _ in rows if not d.startswith(("bad", "empty")) for i in range(2)]
        return spark.createDataFrame(good, "id string, document_id string, text string"), spark.createDataFrame([(d,) for d, _ in rows if d.startswith("bad")], "digest string")

    def sync(**files):
        df = spark.createDataFrame([(d, p) for p, d in files.items()], "path string, digest string").select(F.col("digest").alias("path"), F.col("path").alias("digest"))
        version, plan = synchronise(store, df, prepare, most_deleted=0.6)
        shown = {(r.document_id, tuple(r.paths), r.status) for r in store.manifest().collect()}
        return version, shown, {r.digest: r.action for r in plan.collect()}

    one, shown, _ = sync(a="d1", b="d2", c="d3", e="empty1")
    assert shown == {("d1", ("a",), "indexed"), ("d2", ("b",), "indexed"), ("d3", ("c",), "indexed"), ("empty1", ("e",), "empty")} and one.n_chunks == 6
    # A rename, a content that fails in place of another, a new one: only new contents are prepared, and only they are written.
    two, shown, plan = sync(moved="d1", b="bad2", c="d3", n="d4", e="empty1")
    assert plan == {"d1": "renamed", "d2": "replaced", "bad2": "modified", "d3": "unchanged", "d4": "added", "empty1": "unchanged"} and asked[-1] == ["bad2", "d4"]
    assert shown == {("d1", ("moved",), "indexed"), ("d2", ("b",), "stale"), ("d3", ("c",), "indexed"), ("d4", ("n",), "indexed"), ("empty1", ("e",), "empty")}
    assert two.batches == sorted([one.name, two.name]) and {r.id for r in store.visible_chunks().collect()} == {f"d{i}-1-{k}" for i in (1, 2, 3, 4) for k in (0, 1)}
    # Nothing new: no batch; the failed content is tried again; a deleted one goes.
    three, shown, plan = sync(moved="d1", b="bad2", c="d3", e="empty1")
    assert asked[-1] == ["bad2"] and plan["d4"] == "deleted" and ("d2", ("b",), "stale") in shown and three.n_chunks == 6
    # Chunks that were lost are prepared again.
    batch = tmp_path / f"batch={one.name}"
    kept = spark.read.parquet(str(batch)).where("id <> 'd3-1-1'").collect()
    spark.createDataFrame(kept).write.mode("overwrite").parquet(str(batch))
    spark.catalog.clearCache()
    four, shown, plan = sync(moved="d1", b="bad2", c="d3", e="empty1")
    assert plan["d3"] == "incomplete" and asked[-1] == ["bad2", "d3"] and store.visible_chunks().where("document_id = 'd3'").count() == 2
    five = store.compact()
    assert five.batches == [five.name] and five.revision == four.revision and store.visible_chunks().count() == 6
    with pytest.raises(ValueError, match="deleted"):
        sync(x="d9")
    assert store.current() == five


def test_legacy_owners_and_vectors(spark):
    chunks = spark.createDataFrame([("a" * 16 + "-1-0", None), ("a" * 20 + "-1-0", None), ("b" * 16 + "-1-0", "doc"), ("c" * 16 + "-1-0", None), ("zz-1", None)], "id string, document_id string")
    contents = spark.createDataFrame([("a" * 64,), ("c" * 16 + "0",), ("c" * 16 + "1",)], "digest string")
    assert {r.id for r in legacy_owners(chunks, contents).collect()} == {"a" * 16 + "-1-0", "a" * 20 + "-1-0"}
    texts = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [list(r.vector) for r in with_vectors(texts, lambda: lambda ts: [[float(len(t)), 1.0] for t in ts], 2).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="vector"):
        with_vectors(texts, lambda: lambda ts: [[1.0] for _ in ts], 2).collect()


def test_golden_set(spark, tmp_path):
    def write(cases, version=1):
        path = tmp_path / "g.json"
        write_report(path, {"version": version, "name": "n", "cases": cases})
        return str(path)

    good = [{"id": "1", "question": "q", "expected": "answered", "evidence": [{"source": "a.pdf", "page": 2}]}, {"id": "2", "question": "q", "expected": "abstained"}]
    cases, expected = golden_set(spark, write(good))
    assert [tuple(r) for r in expected.select("case_id", "source", "page").collect()] == [("1", "a.pdf", 2)] and cases.count() == 2
    for bad in ([], [good[0], good[0]], [{**good[0], "evidence": []}], [{**good[1], "evidence": good[0]["evidence"]}], [{**good[0], "question": " "}], [{**good[0], "evidence": [{"source": "a", "page": 0}]}], [{**good[0], "expected": "maybe"}]):
        with pytest.raises(ValueError):
            golden_set(spark, write(bad))
    with pytest.raises(ValueError):
        golden_set(spark, write(good, 2))
    (tmp_path / "l.json").write_text(json.dumps({"examples": [{"query": "q", "passage": "p", "relevant": True}]}))
    assert relevance_labels(spark, str(tmp_path / "l.json")).first().relevant is True


def test_stream_restarts_without_doubles(spark, tmp_path):
    library, target, checkpoint = tmp_path / "lib", str(tmp_path / "out"), str(tmp_path / "cp")
    library.mkdir()
    (library / "a.pdf").write_bytes(PDF)
    (library / "copy.pdf").write_bytes(PDF)
    prepare = lambda df: df.select("digest", F.col("length"))
    for _ in range(2):
        run_available(new_files(spark, str(library)), prepare, target, checkpoint).awaitTermination(120)
    (library / "again.pdf").write_bytes(PDF)
    (library / "new.pdf").write_bytes(PDF + b"!")
    run_available(new_files(spark, str(library)), prepare, target, checkpoint).awaitTermination(120)
    assert spark.read.parquet(f"{target}/batch=*").count() == 2


def test_questions(spark):
    asked = ["explain the dimenson here", "explain the Dimenson", "the dimensoin of the performence"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    known = lambda **n: spark.createDataFrame(list(n.items()), "term string, cf long")
    fixed = lambda f: {r.query_id: r.text for r in corrections(q, f).collect()}
    assert fixed(known(dimension=9, performance=7)) == {0: "explain the dimension here", 2: "the dimension of the performance"}
    assert fixed(known(dimension=2)) == {} and fixed(known(dimension=9, dimenson=1)) == {2: "the dimension of the performence"}
    q = spark.createDataFrame([(0, "What is RAG?"), (1, "Is Retrieval-Augmented  generation new, or RAGs?"), (2, "no name here")], "query_id int, text string")
    named = aliases(q, spark.createDataFrame([("RAG", "retrieval augmented generation")], "acronym string, phrase string"))
    assert {r.query_id: r.text for r in named.collect()} == {0: "What is RAG (retrieval augmented generation)?", 1: "Is Retrieval-Augmented  generation (RAG) new, or RAGs?"}
    lower = spark.createDataFrame([(0, "what  is rag?")], "query_id int, text string")
    assert [tuple(r) for r in variants(q.limit(1), corrected=lower, aliased=named).collect()] == [(0, 1, "What is RAG (retrieval augmented generation)?")]
    planned = spark.createDataFrame([(0, t, i) for i, t in enumerate("abc")], "query_id int, text string, place int")
    assert sorted(tuple(r) for r in variants(q.limit(1), subqueries=planned, aliased=named, most=9).collect()) == [(0, 1, "a"), (0, 2, "b")]
    assert needs_scope("What does this paper say") and not needs_scope("this paper", ["a.pdf"])
    assert instruction("BAAI/bge-small-en-v1.5") and not instruction("other") and not instruction("BAAI/bge-small-en-v1.5", "off")
