import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.config import RetrievalConfig
from marginalia.functions.terms import jaccard, terms, word_family
from marginalia.operators.chunks import chunk_position, latest_by, stored_chunks
from marginalia.operators.dense import nearest
from marginalia.operators.fusion import check_weights, query_budgets, reciprocal_rank_fusion, reserve_candidates, variant_weights
from marginalia.operators.lexical import bm25
from marginalia.operators.select import RetrievalPlan, by_threshold, cap_per_paper, covers, dimensions_of, missing_allocations, mmr, select_by_quota, task_of
from marginalia.search import search, search_with_context


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_word_family(spark):
    for word in ("contribute", "contributes", "contributed", "contributing", "contribution", "contributions"):
        assert one(spark, word_family(F.lit(word))) == "contribute"
    for word, want in {"studies": "study", "classes": "class", "glasses": "glass", "glass": "glass", "virus": "virus", "axis": "axis", "maps": "map", "gas": "gas", "a1s": "a1s"}.items():
        assert one(spark, word_family(F.lit(word))) == want


def test_terms_keep_compounds_parts_and_empty_pieces(spark):
    assert one(spark, terms(F.lit("State-of-the-art C++ end."))) == ["state-of-the-art", "state", "of", "the", "art", "c++", "c", "", "end.", "end", ""]
    assert one(spark, terms(F.lit("Straße Ärzte"))) == ["strasse", "ärzte"]
    assert one(spark, terms(F.lit(None).cast("string"))) == []
    assert one(spark, jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, jaccard(F.array().cast("array<string>"), F.array(F.lit("b")))) == 0.0


def brute_bm25(questions, chunks, k):
    split = lambda t: re.findall(r"[a-z]+", t.lower())
    docs = {i: split(t) for i, t in chunks}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for t in docs.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, text in questions:
        scored = []
        for i, t in docs.items():
            tf = Counter(t)
            if set(split(text)) & set(t):
                scored.append((-round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in split(text)), 9), i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_bm25_equals_the_formula(spark):
    rng = random.Random(1)
    words = ["red", "blue", "green", "stone", "river", "cloud", "tree", "wind"]
    chunks = [(f"c{i:03}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    questions = [(1, "red river red"), (2, "cloud unknown"), (3, "unknown"), (4, "")]
    got = bm25(spark.createDataFrame(questions, "query_id int, text string"), spark.createDataFrame([(i, t, i) for i, t in chunks], "id string, text string, paper string"), 7).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.id)
    assert by == {q: ids for q, ids in brute_bm25(questions, chunks, 7).items() if ids}


def test_terms_of_token_equal_the_columns(spark):
    from marginalia.functions.terms import pieces_of, terms_of_token

    tokens = ["studies", "ies", "dies", "classes", "glass", "maps", "gas", "contributions", "executed", "a1s", "state-of-the-art", "c++", "end.", "x_maps", "and/or.", "u.s.a", "ärzten", "straßes", "名詞", "२०", "1-2-3", "computing", "cuted"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.transform(pieces_of(F.col("t")), word_family).alias("x"))
    assert {r.t: r.x for r in df.collect()} == {t: terms_of_token(t) for t in tokens}


@pytest.mark.parametrize("dense", [4, 0])
def test_bm25_over_many_blocks_and_shards(monkeypatch, dense):
    from types import SimpleNamespace

    import pyarrow as pa

    from marginalia.operators import lexical

    for name, value in {"BLOCK_TOKENS": 40, "SHARD_CHUNKS": 150, "_PROBED": 5, "_DENSE": dense}.items():
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    often = [60 / (i + 1) for i in range(60)]
    texts = [rng.choices(words, often, k=rng.randint(0, 14)) for _ in range(900)]
    texts += texts[:300]  # ties
    ids = [f"c{i:04}" for i in rng.sample(range(9999), len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"p{i % 3}" for i in range(len(ids))]), pa.array(texts, pa.list_(pa.string()))], ["id", "paper", "tokens"])
    blocks = list(lexical._blocks(iter([batch])))
    assert len(blocks) > 100 and sum(b["n"][0].as_py() for b in blocks) == len(ids) and sum(b["total"][0].as_py() for b in blocks) == sum(map(len, texts))
    mean = sum(map(len, texts)) / len(texts)
    asked = [(q, rng.choice([None, None, "p1"]), t, rng.choice([-0.5, 0.0, 0.3, 1.0, 2.0, 4.0])) for q in range(60) for t in rng.sample(words, rng.randint(1, 8))]
    scopes = {q: s for q, s, *_ in asked}
    asked = [(q, scopes[q], t, w) for q, _, t, w in asked]
    table = pa.table(dict(zip(("_q", "scope", "term", "weight"), map(list, zip(*asked)))))
    rows = [r for b in lexical._searching(SimpleNamespace(value=table), mean, 7, pa.string())(iter(blocks)) for r in b.to_pylist()]
    got, want = {}, {}
    for r in rows:
        got.setdefault(r["_q"], []).append((-r["bm25_score"], r["id"]))
    weights = {}
    for q, _, t, w in asked:
        weights.setdefault(q, {})[t] = w
    for q, own in weights.items():
        for n, (i, t) in enumerate(zip(ids, texts)):
            if own.keys() & set(t) and scopes[q] in (None, f"p{n % 3}"):
                score = sum(w * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for x, w in own.items() if x in t)
                want.setdefault(q, []).append((-round(score, 9), i))
    assert {q: [i for _, i in sorted(r)[:7]] for q, r in got.items()} == {q: [i for _, i in sorted(r)[:7]] for q, r in want.items()}


def test_bm25_of_questions_that_share_common_terms(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from marginalia.operators import lexical

    for name, value in {"BLOCK_TOKENS": 300, "SHARD_CHUNKS": 500, "_DENSE": 3}.items():
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    often = [40 / (i + 1) for i in range(40)]
    texts = [rng.choices(words, often, k=rng.randint(0, 14)) for _ in range(2000)]
    texts += texts[:500]  # ties
    ids = [f"c{i:04}" for i in rng.sample(range(9999), len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.string()), pa.array(texts, pa.list_(pa.string()))], ["id", "paper", "tokens"])
    blocks = list(lexical._blocks(iter([batch])))
    mean = sum(map(len, texts)) / len(texts)
    weight = {w: rng.choice([-0.5, 0.0] if i == 3 else [0.3, 1.0, 2.0]) for i, w in enumerate(words)}
    groups = [words[:1], words[:2], words[1:4], ["w3"], ["w30"]]
    asked = {q: {w: weight[w] for w in {*groups[q % 5], *rng.sample(words[4:], q % 4)}} for q in range(60)}
    rows = [(q, None, w, x) for q, own in asked.items() for w, x in own.items()]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.float64()))], ["_q", "scope", "term", "weight"])
    common = frozenset(["w0", "w1", "w2", "w3", "unasked"])
    assert sum(map(len, lexical._Asked(table, common).shared.values())) == 48
    found = [r for b in lexical._searching(SimpleNamespace(value=table), mean, 7, pa.string(), common)(iter(blocks)) for r in b.to_pylist()]
    got = {q: sorted((-r["bm25_score"], r["id"]) for r in found if r["_q"] == q)[:7] for q in asked}
    for q, own in asked.items():
        scored = [(-round(sum(x * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w, x in own.items()), 9), i) for i, t in zip(ids, texts) if own.keys() & set(t)]
        assert [i for _, i in got[q]] == [i for _, i in sorted(scored)[:7]], q
    assert len(found) < 60 * 7 * 2  # of several shards, what isn't among the best of all isn't handed on


def test_bm25_asks_the_same_terms_once(spark, monkeypatch):
    from marginalia.operators import lexical

    chunks = spark.createDataFrame([(i, f"red{i % 5} blue{i % 3} stone stone") for i in range(40)], "id int, text string")
    ask = [(q, f"stone red1 {'stone' if q % 2 else ''} unknown{q}") for q in range(40)] + [(None, "red1 stone")]
    counts, plain = [], lexical._Asked
    monkeypatch.setattr(lexical, "_searching", lambda own, *a, f=lexical._searching: counts.append(len(plain(own.value).questions)) or f(own, *a))
    got = sorted(map(tuple, bm25(spark.createDataFrame(ask, "query_id int, text string"), chunks, 4).collect()), key=repr)
    assert counts == [2] and len(got) == 41 * 4
    for q, text in ask:
        alone = bm25(spark.createDataFrame([(q, text)], "query_id int, text string"), chunks, 4).collect() if q in (None, 0, 1) else None
        assert alone is None or sorted(map(tuple, alone), key=repr) == [r for r in got if r[0] == q]


def test_bm25_topk_asks_with_every_label(spark):
    from marginalia.plans.search_queries import bm25_topk

    data = "/root/testdata/sf0.001"
    asked = {r.label_id for r in latest_by(spark.read.parquet(f"{data}/relevance_labels_to_review.parquet"), "label_id").collect() if r.query}
    assert {r.query_id for r in bm25_topk(spark, data).select("query_id").distinct().collect()} == asked and len(asked) > 100


def test_bm25_in_rounds_of_questions(spark, monkeypatch):
    from marginalia.operators import lexical

    chunks = spark.createDataFrame([(i, f"red{i % 5} blue{i % 3} stone") for i in range(40)], "id int, text string")
    ask = spark.createDataFrame([(q, f"red{q} blue{q} stone") for q in range(5)], "query_id int, text string")
    once = sorted(map(tuple, bm25(ask, chunks, 4).collect()))
    monkeypatch.setattr(lexical, "SENT_TERMS", 3)
    assert sorted(map(tuple, bm25(ask, chunks, 4).collect())) == once and len(once) == 20


def test_bm25_keeps_little_on_disk(spark):
    """Less than the tables it reads; a row a chunk and term, written twice, took half as much again."""
    from pathlib import Path

    from marginalia.plans.search_queries import bm25_topk
    from marginalia.runtime import shared_dir

    data, shared = Path("/root/testdata/sf0.01"), Path(shared_dir(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before = size()
    assert bm25_topk(spark, str(data)).count() > 0
    assert size() - before < sum((data / f"{t}.parquet").stat().st_size for t in ("sync_chunks", "relevance_labels_to_review"))


def test_latest_of_few_equals_latest(spark, monkeypatch):
    from marginalia.operators import chunks as module

    rng = random.Random(5)
    rows = [(f"k{rng.randint(0, 300)}" if rng.random() < 0.95 else None, rng.choice([None, 1, 2, 3]), rng.choice("abc")) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, loaded_at int, v string")
    want = sorted(map(tuple, latest_by(df, "k").collect()), key=repr)
    assert sorted(map(tuple, module.latest_of_few(df, "k").collect()), key=repr) == want
    monkeypatch.setattr(module, "SENT_KEYS", 0)
    assert sorted(map(tuple, module.latest_of_few(df, "k").collect()), key=repr) == want


def test_scope_keeps_statistics(spark):
    chunks = spark.createDataFrame([("a", "red stone", "p"), ("b", "red red", "q"), ("c", "blue", "p")], "id string, text string, paper string")
    ask = lambda scope: {r.id: r.bm25_score for r in bm25(spark.createDataFrame([(1, "red", scope)], "query_id int, text string, scope string"), chunks, 5, scope="scope").collect()}
    assert ask("q").keys() == {"b"} and ask("q")["b"] == ask(None)["b"] and ask(None).keys() == {"a", "b"}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 4, (300, 5)).astype(float)  # many ties
    rows = [(i, v[i].tolist(), i % 3) for i in range(300)] + [(900, None, 1), (901, [1.0], 1), (902, [1.0, None, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, scope int")
    for scope in (None, "scope"):
        got = nearest(df.where("id % 50 = 0 and id < 900"), df, 6, scope=scope, dimension=5).collect()
        for q in range(0, 300, 50):
            d = ((v - v[q]) ** 2).sum(1)
            pool = [i for i in range(300) if scope is None or i % 3 == q % 3]
            assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == sorted(pool, key=lambda i: (d[i], i))[:6]
    assert nearest(df.limit(0), df, 3).collect() == []


def test_fusion(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "a", 3), (1, 1, "a", 1), (1, 1, "c", 2)]
    out = {r.id: (r.rrf_score, r["rank"]) for r in reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id int, list_no int, id string, rank int")).collect()}
    assert out["a"] == (round(2 / 61, 12), 1) and out["b"] == (round(1 / 62, 12), 2) and out["c"][1] == 3
    assert [query_budgets(20, n) for n in (1, 2, 3)] == [[20], [10, 10], [10, 5, 5]] and query_budgets(51, 3) == [26, 13, 12] and query_budgets(1, 3) == [1, 0, 0]
    assert variant_weights(3) == [1.0, 0.5, 0.5]
    for bad in ([1.0], [1.0, -1.0], [1.0, math.nan]):
        with pytest.raises(ValueError):
            check_weights(bad, 2)
    with pytest.raises(ValueError):
        reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id int, list_no int, id string, rank int"), k=0)


def test_reserved_candidates(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "query_id int, id string, rank int")
    out = reserve_candidates(ranked("abcdef"), ranked("xyzab"), 5).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.place)] == ["a", "b", "c", "x", "y"]


CANDIDATE = "query_id int, id string, paper string, reranker_score double, rrf_score double, rank int, terms array<string>"


def brute_mmr(rows, k, balance, cap):
    low, high = min(r[2] for r in rows), max(r[2] for r in rows)
    rel = lambda r: 1.0 if high == low else (r[2] - low) / (high - low)
    like = lambda a, b: len(set(a[3]) & set(b[3])) / len(set(a[3]) | set(b[3])) if a[3] and b[3] else 0.0
    chosen = []
    while len(chosen) < k:
        open_ = [r for r in rows if r not in chosen and sum(c[1] == r[1] for c in chosen) < cap]
        if not open_:
            break
        chosen.append(min(open_, key=lambda r: (-round(balance * rel(r) - (1 - balance) * max((like(r, c) for c in chosen), default=0.0), 12), -r[2], r[0])))
    return [r[0] for r in chosen]


def test_mmr_equals_greedy(spark):
    rng = random.Random(7)
    rows = [(f"c{i:02}", f"p{i % 4}", round(rng.random(), 2), rng.sample("abcdefgh", rng.randint(0, 5))) for i in range(20)]
    df = spark.createDataFrame([(1, i, p, s, 0.0, n, t) for n, (i, p, s, t) in enumerate(rows, 1)], CANDIDATE)
    for k, balance, cap in ((5, 0.75, 2), (8, 0.3, 1), (3, 1.0, 9)):
        got = [r.id for r in sorted(mmr(df, k, balance, cap).collect(), key=lambda r: r.place)]
        assert got == brute_mmr(rows, k, balance, cap)


def test_threshold_is_inclusive_and_caps(spark):
    df = spark.createDataFrame([(1, "a", "p", 0.5, 0.0, 1, None), (1, "b", "p", 0.499, 0.0, 2, None), (1, "c", "p", None, 0.0, 3, None), (1, "d", "p", float("nan"), 0.0, 4, None)], CANDIDATE)
    kept, rejected = by_threshold(df, 0.5)
    assert [r.id for r in kept.collect()] == ["a"] and sorted(r.id for r in rejected.collect()) == ["b", "c", "d"]
    assert sorted((r.id, r.final_rank) for r in cap_per_paper(df, 2, 5).collect()) == [("a", 1), ("b", 2)]


def row(i, paper, text, section="s"):
    return {"id": i, "paper": paper, "source": f"{paper}.pdf", "section": section, "text": text}


def test_quotas(spark):
    rows = [row("a1", "a", "latency is low"), row("a2", "a", "cost"), row("a3", "a", "latency again"), row("b1", "b", "cost of it")]
    df = spark.createDataFrame([(1, i, *r.values()) for i, r in enumerate(rows)], "query_id int, rank int, id string, paper string, source string, section string, text string")
    chosen = lambda *args, **more: [r.id for r in select_by_quota(df, *args, **more).orderBy("place").collect()]
    plan = RetrievalPlan("comparison", ("a.pdf", "b.pdf"), ("latency", "cost"))
    assert chosen(plan, 4, 2) == ["a1", "a2", "b1", "a3"]
    assert [tuple(r) for r in missing_allocations(df, plan).collect()] == [(1, "b.pdf", "latency")]
    assert {tuple(r) for r in missing_allocations(df, RetrievalPlan("comparison", ("a.pdf", "c.pdf"))).collect()} == {(1, "c.pdf", None), (1, "c.pdf", "all")}
    assert chosen(RetrievalPlan(), 4, 1) == ["a1", "b1"] and chosen(RetrievalPlan("summary"), 3, 1) == ["a1", "b1", "a2"]
    assert chosen(RetrievalPlan(), 2, 9, fits=lambda r: all(x["id"] != "a1" for x in r)) == ["a2", "b1"]
    assert select_by_quota(df.limit(0), RetrievalPlan(), 3, 1).collect() == []
    said = lambda t: one(spark, covers(F.lit(t), F.lit("improves"), F.lit(True)))
    assert not said("It never improves. It falls.") and said("It falls. It improves.")
    assert one(spark, dimensions_of(F.lit("Compare A and B on cost, speed and size?"))) == ["cost", "speed", "size"] and one(spark, dimensions_of(F.lit("Tell me on what"))) == []
    assert one(spark, task_of(F.lit("Do they disagree?"))) == "conflict" and one(spark, task_of(F.lit("Give an overview"))) == "summary"


def test_latest_and_position(spark):
    df = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("x", None, "none"), (None, 9, "no"), ("y", 1, "b"), ("y", 1, "a")], "k string, loaded_at int, v string")
    assert sorted(tuple(r) for r in latest_by(df, "k").collect()) == [("x", 2, "new"), ("y", 1, "b")]
    ids = spark.createDataFrame([("a" * 16 + "-3-7", 3, None), ("a" * 16 + "-3-7", 4, None), ("q", 3, 1), ("a" * 16 + "-3-7-" + "b" * 16, 3, None)], "id string, page int, i int")
    assert [tuple(r.p) if r.p else None for r in ids.select(chunk_position(F.col("id"), F.col("page"), F.col("i")).alias("p")).collect()] == [(3, 7), None, (3, 1), (3, 7)]


def test_whole_search(spark):
    chunk = "chunk_id string, document_id string, file_hash string, source string, source_paths string, title string, section string, page int, chunk_index int, section_id int, paragraph_start int, paragraph_end int, character_start int, character_end int, text string, loaded_at timestamp"
    texts = ["red stones in rivers", "blue clouds above trees", "red rivers and stones", "green trees"]
    rows = [(f"c{i}", f"d{i % 2}", None, f"s{i % 2}.pdf", None, None, None, 1, i, 0, 0, 0, 0, 9, t, None) for i, t in enumerate(texts)]
    chunks = stored_chunks(spark.createDataFrame(rows, chunk))
    ask = spark.createDataFrame([(1, "red river stones"), (2, "nothing here at all")], "query_id int, text string")
    out = search(ask, chunks, RetrievalConfig(final_results=2)).collect()
    assert {r.query_id for r in out} == {1} and {r.id for r in out} == {"c0", "c2"} and [r.place for r in sorted(out, key=lambda r: r.place)] == [1, 2]
    assert {r.id for r in search(ask, chunks, RetrievalConfig(mode="hybrid")).collect()} == {"c0", "c2"}
    with pytest.raises(ValueError):
        search(ask, chunks, RetrievalConfig(mode="dense"))


def test_search_shuffles_only_texts_that_were_listed(spark, monkeypatch):
    from marginalia import search as module
    from marginalia.plans import search_queries

    read = []
    real = module.rerank
    monkeypatch.setattr(module, "rerank", lambda candidates, *args: read.append(candidates) or real(candidates, *args))
    want = sorted(map(tuple, search_queries.lexical_search(spark, "/root/testdata/sf0.001").collect()))
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan and want
    monkeypatch.setattr(module, "SENT_IDS", 0)
    assert sorted(map(tuple, search_queries.lexical_search(spark, "/root/testdata/sf0.001").collect())) == want


def test_search_forms_scope_and_context(spark):
    from marginalia.config import ContextConfig, RetrievalConfig

    text = "River floods in spring.\n\nLakes freeze in winter.\n\nRivers dry out."
    spans = [(text.index(t), text.index(t) + len(t), t) for t in text.split("\n\n")]
    chunks = spark.createDataFrame([(f"{d}{i}", d, f"{d}.pdf", d, 1, t, a, b, 1) for d in "ab" for i, (a, b, t) in enumerate(spans)], "id string, paper string, source string, document_id string, page int, text string, character_start int, character_end int, section_id int")
    asked = spark.createDataFrame([(1, "when do rivers flood", "a"), (2, "lakes in this paper", None), (3, "lakes in this paper", "b")], "query_id int, text string, scope string")
    config = RetrievalConfig(final_results=1, reranker_min_score=0.0)
    found = search(asked, chunks, config)
    assert {(r.query_id, r.id) for r in found.collect()} <= {(1, "a0"), (1, "a2"), (3, "b1")} and {r.query_id for r in found.collect()} == {1, 3}
    forms = spark.createDataFrame([(1, 1, "lakes freeze")], "query_id int, variant int, text string")
    more = search(asked.where("query_id = 1"), chunks, RetrievalConfig(mode="hybrid", final_results=9, max_chunks_per_paper=9), variants=forms).collect()
    assert {r.id for r in more} == {"a0", "a1", "a2"}
    pages = spark.createDataFrame([(d, 1, text) for d in "ab"], "document_id string, page int, text string")
    paragraphs_ = chunks.select("document_id", "page", F.col("character_start").alias("start"), F.col("character_end").alias("end"), "section_id")
    blocks = search_with_context(asked.where("query_id = 3"), chunks, pages, paragraphs_, config, ContextConfig()).collect()
    assert [(r.document_id, r.text, r.kind) for r in blocks] == [("b", text, "anchor_context")]
