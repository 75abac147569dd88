"""Exact nearest neighbours, block against block.

Vectors and query vectors are gathered into matrices of bounded size; each pair of
blocks is one matrix product that keeps the k nearest of each query, and a window
over those few rows ends the search.  With a restriction, blocks hold one scope each and
meet by it, so a restricted query never touches another scope's vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.runtime import parallel

BLOCK = 4096
SPREAD = 64  # parts into which the vectors of one scope may be spread
DIGITS = 9


_ARROW = {"string": pa.string(), "bigint": pa.int64()}


def _gather(kind: pa.DataType, dimension: int | None):
    """Blocks of vectors of one length and scope, in the order in which they come."""
    schema = pa.schema([("ids", pa.list_(kind)), ("scope", pa.string()), ("width", pa.int32()), ("matrix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[tuple, tuple[list, list]] = {}
            for i, v, scope in zip(batch["id"].to_pylist(), batch["vector"].to_pylist(), batch["scope"].to_pylist()):
                if v and None not in v and (dimension is None or len(v) == dimension):
                    ids, vectors = waiting.setdefault((scope, len(v)), ([], []))
                    ids.append(i)
                    vectors.append(v)
            rows = [(ids[at : at + BLOCK], scope, width, np.array(vectors[at : at + BLOCK], dtype=np.float64).tobytes()) for (scope, width), (ids, vectors) in waiting.items() for at in range(0, len(ids), BLOCK)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _id_type(df: DataFrame, id_: str) -> str:
    return "bigint" if df.schema[id_].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def blocks(df: DataFrame, id_: str, vector: str, scope: str | None, dimension: int | None) -> DataFrame:
    """Rows of up to BLOCK vectors; null vectors, such with null parts and those of another dimension are left out."""
    kind = _id_type(df, id_)
    chosen = df.select(F.col(id_).cast(kind).alias("id"), F.col(vector).alias("vector"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"))
    if scope:  # a large scope is spread by its ids
        parts = parallel(df.sparkSession)
        chosen = chosen.repartition(parts, "scope", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("scope")
    return chosen.mapInArrow(_gather(_ARROW[kind], dimension), f"ids array<{kind}>, scope string, width int, matrix binary")


def _nearest(k: int, q_kind: pa.DataType, kind: pa.DataType):
    schema = pa.schema([("query_id", q_kind), ("id", kind), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["q_matrix"], dtype=np.float64).reshape(-1, r["width"])
                v = np.frombuffer(r["matrix"], dtype=np.float64).reshape(-1, r["width"])
                distance = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T, 0.0).round(DIGITS)
                ids = np.array(r["ids"], dtype=object)
                rows = []
                for row, query in enumerate(r["q_ids"]):
                    pool, d = np.arange(len(ids)), distance[row]
                    if len(d) > 4 * k:
                        pool = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # keeps all ties of the k-th
                    rows += [(query, i, x) for x, i in sorted(zip(d[pool].tolist(), ids[pool].tolist()))[:k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, id_: str = "id", vector: str = "vector", scope: str | None = None, dimension: int | None = None) -> DataFrame:
    """(``query_id``, ``id``, ``distance``, ``dense_score``, ``rank``): k nearest by squared Euclidean distance, ties by id.

    ``queries`` is a stated set (columns id_, vector and, for a restriction, scope); its blocks meet all blocks of ``vectors``
    of their scope.  A query's null scope is no restriction.  Ids keep their type, whole numbers or text; vectors of several lengths
    meet those of their own length only.
    """
    q = blocks(queries, id_, vector, scope, dimension).select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "scope", "width", "matrix")))
    v = blocks(vectors, id_, vector, scope, dimension)
    same = F.col("q_width") == F.col("width")
    pairs = v.join(q.where("q_scope IS NULL"), same)
    if scope:
        pairs = pairs.unionByName(v.join(q, same & (F.col("q_scope") == F.col("scope"))))
    kinds = [_id_type(queries, id_), _id_type(vectors, id_)]
    found = pairs.select("q_ids", "q_matrix", "ids", "matrix", "width").mapInArrow(_nearest(k, *(_ARROW[x] for x in kinds)), f"query_id {kinds[0]}, id {kinds[1]}, distance double")  # blocks, not rows
    best = W.partitionBy("query_id").orderBy(F.asc("distance"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("dense_score", -F.col("distance"))
    return ranked.withColumns({"query_id": F.col("query_id").cast(queries.schema[id_].dataType), "id": F.col("id").cast(vectors.schema[id_].dataType)})
