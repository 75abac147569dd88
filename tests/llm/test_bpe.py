import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm.bpe import DEFAULT_VOCABULARY, Encoder, encode_pieces, read_vocabulary, token_count, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return read_vocabulary(DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def naive(piece: bytes, ranks) -> list[int]:
    pairs = ranks.one()
    ids = [int(ranks.byte_ids[b]) for b in piece]
    while True:
        best = min(((pairs.get(ids[i] << 20 | ids[i + 1], 1 << 60), i) for i in range(len(ids) - 1)), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return ids
        ids[best[1] : best[1] + 2] = [best[0]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300), max_size=6))
def test_segment_tree_equals_naive_merging(ranks, pieces):
    assert [x.tolist() for x in encode_pieces(pieces, ranks)] == [naive(p, ranks) for p in pieces]


def test_texts_equal_a_library(ranks, library):
    rng = random.Random(3)
    letters = [*" \n\t\x0b\x1c\x1f'sabcdeth12.,-<|>", chr(0x100), chr(0xE9), chr(0x65E5), chr(0x1F600), chr(0x2003), chr(0x3000), chr(0x85), chr(0x200B), chr(0x301)]
    texts = ["", None, " ", "a  b", "a   b", " \n a", "don't we'll I'M", "<|endoftext|>", "x" * 3000, "ab" * 20_000, "  lead", "trail  "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    ids, counts = Encoder(ranks).encode(texts)
    ends = np.cumsum(counts)
    got = [ids[e - n : e].tolist() for e, n in zip(ends, counts)]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_forgetting_changes_nothing(ranks, monkeypatch):
    import marginalia.llm.bpe as bpe

    texts = [f"word{i} again and again" for i in range(300)]
    want = Encoder(ranks).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 10)
    e = Encoder(ranks)
    for i, t in enumerate(texts):
        assert len(e.encode([t])[0]) == want[1][i]


def test_column(spark, library):
    rows = [(1, "Hello there, general."), (2, None), (3, ""), (4, "é " * 5000), (1, "Hello there, general.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    out = df.withColumn("ids", token_ids(spark)(F.col("text"))).withColumn("n", token_count(spark)(F.col("text"))).collect()
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.n == len(want)
    assert df.limit(0).select(token_ids(spark)(F.col("text")).alias("ids")).collect() == []
