"""Matrices in blocks: one row per block, its entries in arrays.

A product takes the entries of two blocks together and sums them before anything
is shuffled, so a shared index that many rows and columns have costs a row per
cell of the result and block, not one per term.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.operators.sparse import SparseMat, _need, _same, _summed

#: Rows and columns of a block, so that one holds at most SIDE * SIDE entries.
SIDE = 512


@dataclass(frozen=True)
class BlockMat:
    """Blocks ``(bi, bj, starts, cols, cells)`` of ``side`` rows and columns.

    A block is compressed by rows: the entries of its row ``r`` are those from
    ``starts[r]`` to ``starts[r + 1]`` of ``cols`` (places within the block, in
    order) and ``cells``. Blocks without entries are not stored."""

    df: DataFrame
    n_rows: int
    n_cols: int
    side: int


_BLOCK = "bi bigint, bj bigint, starts array<int>, cols array<int>, cells array<double>"


def _compressed(places: np.ndarray, cells: np.ndarray, side: int):
    """``starts, cols, cells`` of a block from entries at ``row * side + col``,
    those of one place summed in order of their size, zeros kept."""
    order = np.lexsort((cells, places))
    places, cells = places[order], cells[order]
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    places, cells = places[first], np.add.reduceat(cells, first)
    starts = np.searchsorted(places, np.arange(side + 1) * side)
    return starts.astype(np.int32), (places % side).astype(np.int32), cells


def to_blocks(a: SparseMat, side: int = SIDE, coalesced: bool = False) -> BlockMat:
    """``a`` in blocks; entries stored under one index are summed.

    ``coalesced`` says that no index is stored twice, as after ``coalesce``, a product
    or a grouping by both indices. Entries then go to their blocks as they come; to
    sum them once more would hold a task's entries two more times."""
    _need(SparseMat, a)
    if side < 1 or side > 4_096:
        raise ValueError(f"side must be from 1 to 4096, got {side}")
    # one entry per index, so that no block gathers more than side * side of them
    once = a.df if coalesced else a.df.groupBy("i", "j").agg(F.sum("value").alias("value"))
    entries = once.select(
        F.floor(F.col("i") / side).alias("bi"),
        F.floor(F.col("j") / side).alias("bj"),
        (F.pmod("i", F.lit(side)) * side + F.pmod("j", F.lit(side))).cast("int").alias("place"),
        "value",
    )

    def run(block: pa.Table) -> pa.Table:
        starts, cols, cells = _compressed(block["place"].to_numpy(), block["value"].to_numpy(), side)
        columns = [block["bi"].slice(0, 1), block["bj"].slice(0, 1), pa.array([starts]), pa.array([cols]), pa.array([cells])]
        return pa.table(columns, names=["bi", "bj", "starts", "cols", "cells"])

    return BlockMat(entries.groupBy("bi", "bj").applyInArrow(run, _BLOCK), a.n_rows, a.n_cols, side)


def from_blocks(a: BlockMat) -> SparseMat:
    """The stored entries ``(i, j, value)`` of a matrix in blocks."""
    _need(BlockMat, a)
    side = a.side

    def run(batches):
        for batch in batches:
            bi, bj = (batch.column(c).to_numpy() for c in ("bi", "bj"))
            for k in range(batch.num_rows):
                starts, cols, cells = (np.asarray(batch.column(c)[k].values) for c in ("starts", "cols", "cells"))
                rows = np.repeat(np.arange(side), np.diff(starts))
                arrays = [pa.array(bi[k] * side + rows), pa.array(bj[k] * side + cols), pa.array(cells)]
                yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "value"])

    return SparseMat(a.df.mapInArrow(run, "i bigint, j bigint, value double"), a.n_rows, a.n_cols)


def block_transpose(a: BlockMat) -> BlockMat:
    """Blocks and their entries turned, without a shuffle."""
    _need(BlockMat, a)
    side = a.side

    def run(batches):
        for batch in batches:
            out = []
            for starts, cols, cells in zip(*(batch.column(c) for c in ("starts", "cols", "cells"))):
                starts, cols, cells = (np.asarray(x.values) for x in (starts, cols, cells))
                rows = np.repeat(np.arange(side), np.diff(starts))
                out.append(_compressed(cols.astype(np.int64) * side + rows, cells, side))
            arrays = [pa.array([b[k] for b in out], t) for k, t in enumerate((pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column("bj"), batch.column("bi"), *arrays], ["bi", "bj", "starts", "cols", "cells"])

    return BlockMat(a.df.mapInArrow(run, _BLOCK), a.n_cols, a.n_rows, side)


def multiplied(left, right, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``row * side + col`` and values of the product of two blocks, each
    ``(starts, cols, cells)``; terms are formed a bounded number at a time."""
    (starts, cols, cells), (starts_2, cols_2, cells_2) = left, right
    rows = np.repeat(np.arange(side), np.diff(starts))
    counts = np.diff(starts_2)[cols]
    total = np.zeros(side * side)
    # entries of the left block whose terms are formed together
    ends = np.cumsum(counts)
    low = 0
    while low < len(cols):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 4_000_000, side="right")))
        n = counts[low:high]
        at = np.repeat(starts_2[cols[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        places = np.repeat(rows[low:high], n) * side + cols_2[at]
        total += np.bincount(places, np.repeat(cells[low:high], n) * cells_2[at], minlength=side * side)
        low = high
    found = np.flatnonzero(total)
    return found, total[found]


def block_terms(a: BlockMat, b: BlockMat) -> DataFrame:
    """``(i, j, value)``: the products of all pairs of blocks that meet, each summed
    within its pair of blocks; what :func:`block_mul` shuffles to sum up."""
    _need(BlockMat, a, b)
    _same(a.n_cols, b.n_rows)
    _same(a.side, b.side)
    side = a.side
    names = ("starts", "cols", "cells")
    left = a.df.select("bi", F.col("bj").alias("bk"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = b.df.select(F.col("bi").alias("bk"), "bj", *[F.col(c).alias(f"b_{c}") for c in names])

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("a_starts", "a_cols", "a_cells", "b_starts", "b_cols", "b_cells")]
            bi, bj = (batch.column(c).to_numpy() for c in ("bi", "bj"))
            for k in range(batch.num_rows):
                arrays = [np.asarray(c[k].values) for c in columns]
                places, values = multiplied(arrays[:3], arrays[3:], side)
                i, j = bi[k] * side + places // side, bj[k] * side + places % side
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(values)], ["i", "j", "value"])

    pairs = left.join(right, "bk").select("bi", "bj", *[f"{m}_{c}" for m in "ab" for c in names])
    return pairs.mapInArrow(run, "i bigint, j bigint, value double")


def block_mul(a: BlockMat, b: BlockMat) -> SparseMat:
    """The product, zeros dropped."""
    return SparseMat(_summed(block_terms(a, b), "i", "j"), a.n_rows, b.n_cols)
