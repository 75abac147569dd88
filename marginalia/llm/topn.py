"""The N best items of every group, by skipping what statistics rule out.

``write_clustered`` is a sink: files hold neighbouring groups, by a range
partitioning that cuts a very large group over as many files as its rows need.
Inside a file the leading items of its groups stand in row groups of their own,
the many others behind them in further ones, so that a small group next to a large one
doesn't force the large one to be read.  An index beside the files tells for each row group which groups it
contains, how many rows of each, and their best, least and some scores between.

``top_n`` reads the index first.  For each group it derives a score that N rows are known to
reach, drops the row groups that lie strictly below it for every group they
contain, and reads the others file by file in descending order of their best
score, skipping again what falls below the N-th scores found meanwhile.  At
most N rows of a group leave a file; one small shuffle merges them.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.runtime import Scratch, blocks_for

ROWS_PER_FILE = 1_000_000
ROWS_PER_ROW_GROUP = 8192
#: So many leading items of a group in a file are kept apart from the rest: good for every N up to it.
HEAD = 16
COLUMNS = ("_group", "_score", "_second", "_id")


def best_first() -> list:
    """The one order of items: score, then second score, both descending, then the smallest id."""
    return [F.desc("_score"), F.desc("_second"), F.asc("_id")]


@dataclass
class Clustered:
    """A written layout: its index, one row for each row group and group in it, and the kinds of its columns."""

    index: DataFrame
    kinds: dict[str, str]


def write_clustered(items: DataFrame, scratch: Scratch, name: str, *, rows_per_file: int = ROWS_PER_FILE, rows_per_row_group: int = ROWS_PER_ROW_GROUP, head: int = HEAD) -> Clustered:
    """Writes (``_group`` string, ``_score``, ``_second`` double, ``_id``) clustered by group, best first.

    The items are written plain before: the range partitioning reads its input
    twice, once to sample the boundaries, and so never runs the joins behind it twice.
    A file counts once the index names it, so those of failed or repeated attempts are never read.
    """
    plain = scratch.write(items.select(*COLUMNS), f"{name}-plain")
    parts = max(scratch.spark.sparkContext.defaultParallelism, blocks_for(plain.count(), rows_per_file))
    order = [F.asc("_group"), *best_first()]
    laid = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    index = scratch.write(laid.mapInArrow(_write_file(scratch.path(f"{name}-files"), rows_per_row_group, head), _INDEX_SQL), f"{name}-index")
    scratch.drop(f"{name}-plain")
    return Clustered(index, {c: plain.schema[c].dataType.simpleString() for c in COLUMNS})


_INDEX = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("_group", pa.string()), ("n_rows", pa.int64()), ("greatest", pa.float64()), ("least", pa.float64()), ("steps", pa.list_(pa.float64()))])
_INDEX_SQL = "path string, row_group int, _group string, n_rows bigint, greatest double, least double, steps array<double>"


def _runs(groups: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values, first rows and lengths of the runs of equal groups."""
    codes = pc.run_end_encode(groups)
    ends = np.asarray(codes.run_ends)
    starts = np.concatenate([[0], ends[:-1]])
    return codes.values, starts, ends - starts


def _rank_in_run(t: pa.Table) -> np.ndarray:
    _, starts, n = _runs(t["_group"].combine_chunks())
    return np.arange(t.num_rows) - np.repeat(starts, n)


def _first_n(t: pa.Table, n: int) -> pa.Table:
    """The first N rows of each run of a group; rows come grouped and best first."""
    return t.filter(pa.array(_rank_in_run(t) < n)) if t.num_rows else t


def _write_file(folder: str, rows: int, head: int):
    """One file for each partition, with a name of its own for each attempt; gives the rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.parquet"
        fs, inner = pafs.FileSystem.from_uri(path)
        writer, stream, written = None, None, 0
        waiting: dict[bool, list[pa.Table]] = {True: [], False: []}
        last, seen = None, 0  # the group under way and its rows so far

        def flush(leading: bool, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal writer, stream, written
            while sum(t.num_rows for t in waiting[leading]) >= least:
                t = pa.concat_tables(waiting[leading]).combine_chunks()
                part, rest = t.slice(0, rows), t.slice(rows)
                if writer is None:
                    fs.create_dir(inner.rsplit("/", 1)[0])
                    stream = fs.open_output_stream(inner)
                    writer = pq.ParquetWriter(stream, part.schema)
                writer.write_table(part, row_group_size=rows)
                groups, starts, n = _runs(part["_group"].combine_chunks())
                score = part["_score"].to_numpy()
                steps = [score[s + (1 << np.arange(int(k).bit_length())) - 1] for s, k in zip(starts, n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(n)), pa.array([written] * len(n), pa.int32()), groups, pa.array(n, pa.int64()), pa.array(score[starts]), pa.array(score[starts + n - 1]), pa.array(steps, pa.list_(pa.float64()))], schema=_INDEX
                )
                written += 1
                waiting[leading] = [rest] if rest.num_rows else []

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            rank = _rank_in_run(t)
            groups, _, n = _runs(batch["_group"])
            if groups[0].as_py() == last:
                rank[: n[0]] += seen
            last, seen = groups[-1].as_py(), int(rank[-1]) + 1
            for leading in (True, False):
                own = t.filter(pa.array((rank < head) == leading))
                if own.num_rows:
                    waiting[leading].append(own)
                    yield from flush(leading, rows)
        for leading in (True, False):
            yield from flush(leading, 1)
        if writer is not None:
            writer.close()
            stream.close()

    return run


def plan_row_groups(index: DataFrame, n: int) -> DataFrame:
    """Adds ``skip`` to index rows: N rows of the row's group, wherever they are, are known to score higher than all its rows here.

    Two levels: each file hands on the rows of the index that make up its own first N, so a group
    over very many files doesn't meet in one task with all its rows.
    """
    step = (n - 1).bit_length()  # 2^step is the least power of two that isn't below N
    enough = F.col("n_rows") >= (1 << step)
    known = index.select("path", "row_group", "_group", F.when(enough, F.lit(1 << step)).otherwise(F.col("n_rows")).alias("_n"), F.when(enough, F.get("steps", F.lit(step))).otherwise(F.col("least")).alias("_reach"))
    for keys in (["_group", "path"], ["_group"]):
        order = W.partitionBy(*keys).orderBy(F.desc("_reach"), F.asc("path"), F.asc("row_group"))
        known = known.withColumn("_sum", F.sum("_n").over(order)).where(F.col("_sum") - F.col("_n") < n)
    bound = known.where(F.col("_sum") >= n).groupBy("_group").agg(F.max("_reach").alias("_bound"))
    return index.join(bound, "_group", "left").withColumn("skip", F.coalesce(F.col("greatest") < F.col("_bound"), F.lit(False))).drop("_bound")


def kept_row_groups(index: DataFrame, n: int) -> DataFrame:
    """The rows of the index in row groups where at least one group can't be skipped."""
    each = W.partitionBy("path", "row_group")
    return plan_row_groups(index, n).withColumn("_all", F.min("skip").over(each)).where(~F.col("_all")).drop("_all", "steps")


def _read_file(n: int):
    def run(wanted: pa.Table) -> pa.Table:
        path = wanted["path"][0].as_py()
        inside: dict[int, list[tuple[str, float]]] = {}
        for k, g, s in zip(wanted["row_group"].to_pylist(), wanted["_group"].to_pylist(), wanted["greatest"].to_pylist()):
            inside.setdefault(k, []).append((g, s))
        often = {g for g, c in Counter(wanted["_group"].to_pylist()).items() if c > 1}
        nth: dict[str, np.ndarray] = {}  # N best scores so far of groups that stand in several row groups
        found = []
        fs, inner = pafs.FileSystem.from_uri(path)
        with pq.ParquetFile(fs.open_input_file(inner)) as f:
            for k in sorted(inside, key=lambda k: (-max(s for _, s in inside[k]), k)):
                if all(len(nth.get(g, ())) == n and s < nth[g][-1] for g, s in inside[k]):
                    continue
                best = _first_n(f.read_row_group(k, columns=list(COLUMNS)), n)
                groups, starts, sizes = _runs(best["_group"].combine_chunks())
                scores = best["_score"].to_numpy()
                for g, s, c in zip(groups.to_pylist(), starts.tolist(), sizes.tolist()):
                    if g in often:
                        nth[g] = np.sort(np.concatenate([nth.get(g, np.zeros(0)), scores[s : s + c]]))[::-1][:n]
                found.append(best)
        whole = pa.concat_tables(found)
        if len(found) > 1:
            whole = _first_n(whole.sort_by([("_group", "ascending"), ("_score", "descending"), ("_second", "descending"), ("_id", "ascending")]), n)
        return whole

    return run


def top_n(laid: Clustered, n: int) -> DataFrame:
    """Up to N rows a group of what :func:`write_clustered` wrote, with ``rank`` from 1.

    Ties in both scores go to the smallest id; the order is the same on every run.
    """
    kinds = ", ".join(f"{c} {k}" for c, k in laid.kinds.items())
    best = kept_row_groups(laid.index, n).groupBy("path").applyInArrow(_read_file(n), kinds)
    order = W.partitionBy("_group").orderBy(*best_first())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def skipped(laid: Clustered, n: int) -> DataFrame:
    """One row: row groups and rows of the layout, and those that the N best of each group are found without."""
    each = plan_row_groups(laid.index, n).groupBy("path", "row_group").agg(F.min("skip").alias("skip"), F.sum("n_rows").alias("n"))
    left_out = F.when(F.col("skip"), F.col("n"))
    return each.agg(F.count(F.lit(1)).alias("n_row_groups"), F.count(left_out).alias("n_skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(left_out), F.lit(0)).alias("n_rows_skipped"))
