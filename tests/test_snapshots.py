import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.functions.bitmap import CompressedBitmap
from marginalia.operators import snapshots
from marginalia.operators.snapshots import SnapshotState, manifest_changes, manifest_changes_since
from pyspark.sql import functions as F

SCHEMA = "snapshot_no int, loaded_at timestamp, document_id string, file_hash string, source_paths string, extra string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000)), st.sets(st.integers(0, 300_000)))
def test_bitmap_is_a_set(a, b):
    x, y = CompressedBitmap.of(np.array(sorted(a))), CompressedBitmap.of(np.array(sorted(b)))
    assert set(x.and_not(y).ordinals().tolist()) == a - b
    assert set(x.and_(y).ordinals().tolist()) == a & b
    assert len(x) == len(a)


def test_dense_containers():
    a, b = np.arange(0, 120_000, 2), np.arange(0, 120_000, 3)
    x, y = CompressedBitmap.of(a), CompressedBitmap.of(b)
    assert x.nbytes() < a.nbytes
    assert x.and_not(y).ordinals().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert x.and_(y).ordinals().tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def rows(spark, data):
    import datetime as dt

    at = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    return spark.createDataFrame([(s, at(t), d, h, p, "x") for s, t, d, h, p in data], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_kinds_notation_late_rows_and_nulls(spark):
    data = [
        (1, 0, "a", "AB12", '["x.pdf"]'), (1, 0, "b", "cd", '["y.pdf","z.pdf"]'), (1, 0, "c", None, None), (1, 0, "d", "ee", "[]"), (1, 0, None, "zz", "[]"), (1, 0, "g", "aa", None),
        (4, 0, "a", "sha256:ab12 ", ' [ "x.pdf", "x.pdf" ] '), (4, 0, "b", "cd", '["z.pdf","y.pdf"]'), (4, 0, "c", "00", None), (4, 0, "d", "ff", "[]"), (4, 900, "d", "EE", "[ ]"), (4, 0, "e", "11", "[]"), (4, 0, "  ", "1", "[]"),
        (4, None, "g", "bb", "[]"), (4, 1, "g", "aa", "[]"),
        (9, 0, "a", "ab12", '["x2.pdf"]'), (9, 0, "b", "cd", "not json"),
    ]
    assert found(manifest_changes(rows(spark, data))) == [(4, "c", "changed"), (4, "e", "added"), (9, "a", "changed"), (9, "b", "changed"), (9, "c", "removed"), (9, "d", "removed"), (9, "e", "removed"), (9, "g", "removed")]


def test_empty_table_single_snapshot_and_snapshot_without_keys(spark):
    assert found(manifest_changes(rows(spark, []))) == []
    assert found(manifest_changes(rows(spark, [(1, 0, "a", "1", None)]))) == []
    assert found(manifest_changes(rows(spark, [(1, 0, "a", "1", None), (2, 0, None, "1", None)]))) == [(2, "a", "removed")]


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    data = []
    for s in (3, 5, 6):
        for k in range(400):
            if rng.random() < 0.8:
                data.append((s, rng.randint(0, 5), f"k{k}", rng.choice("ab"), json.dumps(rng.sample(["p", "q"], rng.randint(0, 2)))))
        data += [(s, n % 50, "hot", "abc"[n % 3], "[]") for n in range(400)]
    rng.shuffle(data)
    unique = {}
    for s, t, d, h, p in data:  # ties in time are avoided below
        unique[(s, d, t)] = (h, frozenset(json.loads(p)))
    data = [(s, t, d, h, json.dumps(sorted(p))) for (s, d, t), (h, p) in unique.items()]
    state = {}
    for (s, d, _), v in sorted(unique.items(), key=lambda x: x[0][2]):
        state.setdefault(s, {})[d] = v
    want = []
    for before, now in ((3, 5), (5, 6)):
        for d in state[before].keys() | state[now].keys():
            a, b = state[before].get(d), state[now].get(d)
            if a != b:
                want.append((now, d, "added" if a is None else "removed" if b is None else "changed"))
    assert found(manifest_changes(rows(spark, data), blocks=7)) == sorted(want)


def test_ordinals_persist_and_go_with_their_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "SEGMENT_BITS", 3)  # several segments a block
    first = [(1, 0, f"k{i}", "1", None) for i in range(50)] + [(2, 0, f"k{i}", str(i % 2), None) for i in range(45)]
    later = [(5, 0, f"k{i}", "1", None) for i in range(48)] + [(5, 0, f"n{i}", "1", None) for i in range(30)]
    last = [(6, 0, f"n{i}", "1", '["x"]') for i in range(60)]
    changes, state = manifest_changes_since(rows(spark, first), blocks=3)
    state.save(str(tmp_path / "a"))
    got, old = found(changes), {r._key: (r._block, r._ordinal) for r in state.rows.collect()}
    for n, part in enumerate((later, last)):
        before = SnapshotState.load(spark, str(tmp_path / "ab"[n]))
        assert (before.blocks, before.snapshot) == (3, (2, 5)[n])
        changes, state = manifest_changes_since(rows(spark, part), state=before)
        state.save(str(tmp_path / "bc"[n]))
        got += found(changes)
    new = {r._key: (r._block, r._ordinal) for r in SnapshotState.load(spark, str(tmp_path / "c")).rows.collect()}
    assert len(new) == 110 and all(new[k] == v for k, v in old.items()) and len(set(new.values())) == 110
    assert sorted(got) == found(manifest_changes(rows(spark, first + later + last)))
    with pytest.raises(ValueError, match="blocks"):
        manifest_changes(rows(spark, last), state=before, blocks=4)
    with pytest.raises(ValueError, match="later"):
        manifest_changes(rows(spark, later), state=before)
    assert found(manifest_changes(rows(spark, []), state=before)) == []


def test_clashing_columns(spark):
    df = rows(spark, [(1, 0, "a", "1", None), (2, 0, "b", "1", None)]).withColumn("_key", F.lit("x")).withColumn("_block", F.lit(1)).withColumn("change_kind", F.lit("y"))
    assert found(manifest_changes(df)) == [(2, "a", "removed"), (2, "b", "added")]
