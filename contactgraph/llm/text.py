"""Words, and mixing of 64-bit hashes, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word contracts: U+0020 and U+0009 to U+000D. ``bytes.split()``
#: without arguments splits UTF-8 at exactly these.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: For ``bytes.translate``: A to Z become a to z, in UTF-8 as in ASCII.
LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


#: Texts that a Python worker turns into Python strings at one time.
TEXTS_TOGETHER = 512


def in_pieces(batches: Iterable[pa.RecordBatch], rows: int = TEXTS_TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that not a whole batch of texts is
    held as Python strings beside its Arrow form. What Arrow holds but no longer
    uses is given back after each batch: the worker outlives the task."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        pa.default_memory_pool().release_unused()


def words_column(text: str | Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
