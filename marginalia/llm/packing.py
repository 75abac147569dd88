"""Filling containers of fixed capacity with items of varying size, best-two-fit.

A container is first filled greedily with the largest item that still fits.  Then
its smallest item is taken out again if two unpacked items together fill the
expanded gap more tightly; this repeats until it gains nothing.

Items are dealt into blocks by a hash of their key and size, each block a bounded
number of tokens and rows, and blocks are packed independently.  A block loses less than a
container's space at its end, a share that the block size keeps below a thousandth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import Scratch

ROWS_PER_BLOCK = 1_000_000  # at most about so many, also where they take no space
CONTAINERS_PER_BLOCK = 2000
_SHIFT = 32


class _Unpacked:
    """Items by size; the sizes present are the bits of one integer."""

    def __init__(self, sizes: np.ndarray):
        self.of: dict[int, list[int]] = {}
        for item, size in enumerate(sizes.tolist()):
            self.of.setdefault(size, []).append(item)
        self.bits = sum(1 << s for s in self.of)

    def largest(self, most: int) -> int:
        """The largest size present up to ``most``; 0 if none."""
        return max(0, (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0

    def take(self, size: int) -> int:
        items = self.of[size]
        item = items.pop()
        if not items:
            self.bits &= ~(1 << size)
        return item

    def put(self, size: int, item: int) -> None:
        self.of.setdefault(size, []).append(item)
        self.bits |= 1 << size

    def best_two(self, gap: int, above: int) -> tuple[int, int] | None:
        """Two unpacked sizes with the largest sum in (above, gap]."""
        best, found = above, None
        a = self.largest(gap - 1)
        while a and 2 * a > best:
            b = self.largest(min(gap - a, a))
            if b == a and len(self.of[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = self.largest(a - 1)
        return found


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes in 1..capacity.  The same sizes give the same containers."""
    container = np.zeros(len(sizes), dtype=np.int64)
    left, number = _Unpacked(sizes), 0
    while left.bits:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while size := left.largest(gap):
            inside.append((size, left.take(size)))
            gap -= size
        while gap and left.bits:
            inside.sort(reverse=True)
            size, item = inside[-1]
            two = left.best_two(gap + size, size)
            if two is None:
                break
            inside.pop()
            inside.extend((s, left.take(s)) for s in two)
            left.put(size, item)
            gap += size - sum(two)
        for _, item in inside:
            container[item] = number
        number += 1
    return container


def _pack_block(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("_size", "ascending"), ("_item", "ascending")])
        size = table["_size"].to_numpy().astype(np.int64)
        block = int(table["_block"][0].as_py())
        # Whole containers cut from oversized items come first, then packed items and remainders.
        whole = np.where(size > capacity, size // capacity, 0)
        rest = size - whole * capacity
        whole_row = np.repeat(np.arange(len(size)), whole)
        whole_piece = np.arange(len(whole_row)) - np.repeat(np.cumsum(whole) - whole, whole)
        rest_row = np.flatnonzero((rest > 0) | (size == 0))
        packed = np.zeros(len(rest_row), dtype=np.int64)
        filled = rest[rest_row] > 0
        packed[filled] = pack(rest[rest_row][filled], capacity)  # items without tokens go along in the first
        row = np.concatenate([whole_row, rest_row])
        piece = np.concatenate([whole_piece, whole[rest_row]])
        number = np.concatenate([np.arange(len(whole_row)), len(whole_row) + packed])
        start = piece * capacity
        end = np.minimum(start + capacity, size[row])
        return pa.table(
            {
                "_id": table["_id"].combine_chunks().take(pa.array(row)),
                "piece_index": pa.array(piece.astype(np.int32)),
                "token_start": pa.array(start.astype(np.int32)),
                "token_end": pa.array(end.astype(np.int32)),
                "container_id": pa.array((block << _SHIFT) + number),
            }
        )

    return run


def fill_containers(df: DataFrame, key: str, size: Column, capacity: int, *, containers_per_block: int = CONTAINERS_PER_BLOCK) -> DataFrame:
    """Rows (``key``, ``piece_index``, ``token_start``, ``token_end``, ``container_id``) for all rows of ``df``.

    An item larger than the capacity is divided into full containers and a
    remainder that is packed like any item; no other item is divided.  An item of
    size 0 (or null) is put along in a container of its block and takes no space.
    Each row is an item of its own, also where keys repeat or are null.  An empty
    table gives no rows.  The sizes are written once to the shared folder.  Containers depend on keys and sizes only.
    """
    scratch = Scratch(df.sparkSession, "pack")
    sizes = df.select(F.col(key).alias("_id"), F.greatest(F.coalesce(size.cast("int"), F.lit(0)), F.lit(0)).alias("_size"))
    # Copies of a row are numbered, so an item is known by its content, however the rows lie in files and tasks.
    copies = sizes.groupBy("_id", "_size").agg(F.count(F.lit(1)).alias("_n"))
    items = scratch.write(copies.select("_id", "_size", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_item")), "sizes")
    total, rows = items.agg(F.coalesce(F.sum(F.col("_size").cast("bigint")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, round(total / (capacity * containers_per_block)), rows // ROWS_PER_BLOCK)
    blocked = items.withColumn("_block", F.pmod(F.xxhash64("_id", "_size", "_item"), F.lit(blocks)).cast("int"))
    schema = f"_id {items.schema['_id'].dataType.simpleString()}, piece_index int, token_start int, token_end int, container_id bigint"
    return blocked.groupBy("_block").applyInArrow(_pack_block(capacity), schema).withColumnRenamed("_id", key)
