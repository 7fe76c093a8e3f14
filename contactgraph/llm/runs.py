"""Whole groups out of a stream of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def starts_of_runs(columns: list[np.ndarray]) -> np.ndarray:
    """Positions at which any of the sorted key columns changes, 0 included."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for column in columns:
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables in which no run of equal ``keys`` is cut.

    The rows must come sorted by ``keys``, without nulls in them. What is held
    back between batches is the last run, so callers bound the length of runs.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        last = starts_of_runs([table[k].to_numpy() for k in keys])[-1]
        if last:
            yield table.slice(0, last).combine_chunks()
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
