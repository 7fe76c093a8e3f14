"""Substring deduplication with difference-cover anchors.

Of the positions of a document only those whose remainder modulo the period lies
in a difference cover are anchors. Whatever the positions of two equal windows,
some shift below the period makes both anchors, so windows of ``window`` words
that are equal share an anchor of ``window - period + 1`` words at the same
shift. Anchors that several documents have are extended to all windows that hold
them, and those windows are compared by a 128-bit hash of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.joins import hot_join
from contactgraph.llm.runs import starts_of_runs, whole_runs
from contactgraph.llm.text import in_pieces, mix64
from contactgraph.session import cut_lineage

WINDOW = 50
#: A perfect difference cover: differences of these six reach every remainder modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Odd multipliers of the two rolling hashes, and the seeds of their word hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEEDS = (11, 47)
#: Word hashes that a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Words of the documents that a task compares with each other before the shuffle.
GATHERED_WORDS = 2_000_000
#: Stands for a null id: later than every other.
_NO_ID = 2**63 - 1
#: A range that ends here takes in all windows.
_EVERY = 2**31 - 1
#: Marks a document that brings no windows into the comparison.
_SKIP = -(2**31)

_PLACES = pa.list_(pa.int32())


class _WordHashes(dict):
    """Two hashes of a word, packed side by side."""

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = b"".join(
            xxhash.xxh64_intdigest(word, seed).to_bytes(8, "little") for seed in _SEEDS
        )
        return found


_word_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Array of shape (words, 2)."""
    if len(_word_hashes) > REMEMBERED:
        _word_hashes.clear()
    packed = b"".join(map(_word_hashes.__getitem__, words))
    return np.frombuffer(packed, "<u8").reshape(-1, 2)


class Rolling:
    """Hashes of the windows of one document, of any length and at any positions."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums, self.back = [], []
        for k, base in enumerate(_BASES):
            up = np.full(n, base, np.uint64)
            down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
            if n:
                up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(hashes[:, k] * up)]))
            self.back.append(down)

    def at(self, k: int, places: np.ndarray, length: int) -> np.ndarray:
        sums = self.sums[k]
        return mix64((sums[places + length] - sums[places]) * self.back[k][places])


def cover_positions(n: int, window: int, period: int, cover: tuple) -> np.ndarray:
    """Anchor positions of a document of ``n`` words."""
    if n < window:
        return np.zeros(0, np.int64)
    places = np.arange(n - (window - period))
    return places[np.isin(places % period, cover)]


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _ranges(ids, tags, lows, width: int):
    """Per document, its ranges ``[low, low + width)`` merged, as one flat list
    of ends. Returns ids, tags and lists."""
    order = np.lexsort((lows, tags, ids))
    ids, tags, lows = ids[order], tags[order], lows[order]
    docs = starts_of_runs([ids, tags])
    fresh = np.zeros(len(lows), bool)
    fresh[docs] = True
    fresh[1:] |= lows[1:] > lows[:-1] + width
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(lows)) - 1
    ends = np.stack([lows[first], lows[last] + width], axis=1).ravel()
    return ids[docs], tags[docs], _lists(ends, 2 * np.searchsorted(first, docs))


#: What tasks exchange. ``key`` and the upper half of ``rest`` are the hashes, the
#: lower half of ``rest`` is the tag. ``place`` is the first place times four,
#: plus one for rows that ask, plus two where the task has seen another document.
#: ``more`` has all places of a row that asks from several, or settled ranges.
_MET = "key bigint, rest bigint, id bigint, place bigint, more array<int>"
_MET_NAMES = ["key", "rest", "id", "place", "more"]


def _packed(high: np.ndarray, tags: np.ndarray) -> np.ndarray:
    tags = tags.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
    return ((high >> np.uint64(32) << np.uint64(32)) | tags).view(np.int64)


def _settle(keys, ids, tags, places, reach):
    """Compare what one task has gathered. Rows of a group whose document is not
    the group's first are settled as ranges; the places of the first document
    go on as one row, which asks for the same key elsewhere."""
    order = np.lexsort((places, tags, ids, *reversed(keys)))
    keys, ids, tags, places = [k[order] for k in keys], ids[order], tags[order], places[order]
    starts = starts_of_runs(keys)
    lengths = np.diff(np.append(starts, len(ids)))
    asking = ids == np.repeat(ids[starts], lengths)
    several = np.repeat(ids[starts] != ids[starts + lengths - 1], lengths)

    units = starts_of_runs([*[k[asking] for k in keys], tags[asking]])
    k = [x[asking][units] for x in keys]
    high = k[1] if len(k) > 1 else np.zeros(len(units), np.uint64)
    own = places[asking]
    single = np.diff(np.append(units, len(own))) == 1
    several = several[asking][units]
    for some, repeated in ((single, False), (~single, True)):
        if some.any():
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k[0][some].view(np.int64)),
                    pa.array(_packed(high, tags[asking][units])[some]),
                    pa.array(ids[asking][units][some]),
                    pa.array((own[units] * 4 + 1 + 2 * several)[some]),
                    _lists(own, units).filter(pa.array(some)) if repeated else pa.nulls(n, _PLACES),
                ],
                _MET_NAMES,
            )
    if not asking.all():
        out = ~asking
        i, t, ranges = _ranges(ids[out], tags[out], places[out] - reach[0], reach[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(mix64(i + t).view(np.int64)),
                pa.array(_packed(np.zeros(len(i), np.uint64), t)),
                pa.array(i),
                pa.array(np.zeros(len(i), np.int64)),
                ranges,
            ],
            _MET_NAMES,
        )


def _gather(batches, keys_of, reach):
    """Settle, task by task, the keys that ``keys_of(words, more)`` gives."""
    held, count = [], 0
    for batch in in_pieces(batches):
        for doc, tag, text, *more in zip(*[c.to_pylist() for c in batch.columns]):
            words = (text or "").encode().split()
            keys, places = keys_of(words, *more)
            if len(places):
                held.append((keys, np.full(len(places), doc, np.int64), np.full(len(places), tag, np.int32), places))
            count += len(words)
            if count >= GATHERED_WORDS and held:
                yield from _settle(*_joined(held), reach)
                held, count = [], 0
    if held:
        yield from _settle(*_joined(held), reach)


def _joined(held):
    keys = [np.concatenate(k) for k in zip(*[h[0] for h in held])]
    return keys, *[np.concatenate(x) for x in list(zip(*held))[1:]]


def _meet(rows: DataFrame, reach, any_other: bool) -> DataFrame:
    """``(id, tag, ranges)`` of the asking places that other documents hold too
    (``any_other``) or that a document with a smaller id holds."""

    def run(batches):
        for table in whole_runs(batches, ["key"]):
            place, tags = table["place"].to_numpy(), table["rest"].to_numpy().astype(np.int32)
            asks = (place & 1) == 1
            done = table.filter(pa.array(~asks))
            yield pa.RecordBatch.from_arrays(
                [done["id"].combine_chunks(), pa.array(tags[~asks]), done["more"].combine_chunks()],
                ["id", "tag", "ranges"],
            )
            if not asks.any():
                continue
            asking = table.filter(pa.array(asks))
            place, tags, ids = place[asks], tags[asks], asking["id"].to_numpy()
            starts = starts_of_runs([asking["key"].to_numpy(), asking["rest"].to_numpy() >> 32])
            lengths = np.diff(np.append(starts, len(ids)))
            if any_other:
                found = ids[starts] != ids[starts + lengths - 1]
                found |= np.bitwise_or.reduceat(place & 2, starts) > 0
                found = np.repeat(found, lengths)
            else:
                found = ids > np.repeat(ids[starts], lengths)
            if not found.any():
                continue
            more = asking["more"].combine_chunks().filter(pa.array(found))
            ids, tags, place = ids[found], tags[found], place[found] >> 2
            repeated = more.is_valid().to_numpy(zero_copy_only=False)
            lists = more.drop_null()
            counts = np.diff(lists.offsets.to_numpy())
            i, t, ranges = _ranges(
                np.concatenate([ids[~repeated], np.repeat(ids[repeated], counts)]),
                np.concatenate([tags[~repeated], np.repeat(tags[repeated], counts)]),
                np.concatenate([place[~repeated], lists.flatten().to_numpy().astype(np.int64)]) - reach[0],
                reach[1],
            )
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(t), ranges], ["id", "tag", "ranges"])

    order = ["key", F.shiftright("rest", 32), F.col("place").bitwiseAND(F.lit(1)), "id"]
    ordered = rows.repartition("key").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "id bigint, tag int, ranges array<int>")


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "tag").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _starts(ranges: list[int] | None, n: int) -> np.ndarray:
    """Window starts below ``n`` that lie in any of the ranges."""
    inside = np.zeros(n + 1, np.int64)
    if ranges and n > 0:
        ends = np.clip(np.array(ranges, np.int64), 0, n).reshape(-1, 2)
        np.add.at(inside, ends[:, 0], 1)
        np.add.at(inside, ends[:, 1], -1)
    return np.flatnonzero(np.cumsum(inside)[:n] > 0) if n > 0 else np.zeros(0, np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with an id and a tag that tells texts under one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.hash(text).alias("tag"),
        text.alias("text"),
    )


def _copies(rows: DataFrame) -> DataFrame:
    """``(id, tag)`` of rows whose whole text a row with a smaller id has."""
    texts = rows.select("id", "tag", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))
    first = texts.groupBy("text_md5").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    again = hot_join(texts, first.filter("n > 1").drop("n"), "text_md5")
    return again.filter("id > first").select("id", "tag").distinct()


def repeated_windows(
    docs: DataFrame,
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple = COVER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, tag, ranges)``: per document the starts of its windows whose words
    also start in a document with a smaller id, as a flat list of range ends.
    Ends may lie beyond the last window.

    Of documents with equal texts only the one with the smallest id brings its
    windows into the comparison; all windows of the others start in it.
    Each document is read for its anchors, and those with shared anchors once
    more for their windows. A task settles what its own documents share before
    it shuffles and sends on one row per key, so a passage that many documents
    hold, or one document many times, meets as many rows as there are tasks.
    """
    if not 0 < period <= window:
        raise ValueError("the period must be positive and at most the window")
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover of the period")
    anchor = window - period + 1
    rows = _rows(docs, id_col, text_col)

    def anchors_of(words):
        at = cover_positions(len(words), window, period, cover)
        return ([Rolling(word_hashes(words)).at(0, at, anchor)] if len(at) else None), at

    def windows_of(words, ranges):
        at = _starts(ranges, len(words) - window + 1)
        if not len(at):
            return None, at
        rolling = Rolling(word_hashes(words))
        return [rolling.at(k, at, window) for k in range(2)], at

    # the windows around an anchor at p start from p - period + 1 to p
    around, itself = (period - 1, period), (0, 1)
    anchors = rows.mapInArrow(lambda batches: _gather(batches, anchors_of, around), _MET)
    copies = cut_lineage(_copies(rows)).withColumn("ranges", F.array(F.lit(0), F.lit(_EVERY)))
    candidates = _by_document(
        _meet(anchors, around, any_other=True).union(copies.withColumn("ranges", F.array(F.lit(_SKIP))))
    ).filter(~F.array_contains("ranges", _SKIP))
    windows = (
        rows.join(candidates, ["id", "tag"])
        .select("id", "tag", "text", "ranges")
        .mapInArrow(lambda batches: _gather(batches, windows_of, itself), _MET)
    )
    return _by_document(_meet(windows, itself, any_other=False).union(copies))


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple = COVER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` per row: every word covered by a window
    of :func:`repeated_windows` is removed, the others are joined by one space.

    Null texts count as empty. A null id counts as later than every other. Rows
    with one id never remove from each other. Windows are judged on the input.
    """
    found = repeated_windows(docs, window, period, cover, id_col, text_col)
    rows = _rows(docs, id_col, text_col)

    def run(batches):
        for batch in in_pieces(batches):
            texts, numbers, kept = batch.column(1).to_pylist(), [], []
            for text, ranges in zip(texts, batch.column(2).to_pylist()):
                words = text.encode().split()
                gone = np.zeros(len(words), bool)
                if ranges and len(words) >= window:
                    # a start takes its whole window along, so ranges grow at the end
                    ends = np.array(ranges, np.int64).reshape(-1, 2) + [0, window - 1]
                    gone[_starts(ends.ravel().tolist(), len(words))] = True
                    words = [w for w, out in zip(words, gone.tolist()) if not out]
                numbers.append((len(gone), int(gone.sum())))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in numbers], pa.int64()),
                    pa.array([r for _, r in numbers], pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                ["id", "n_words", "n_removed", "kept"],
            )

    return (
        rows.join(found, ["id", "tag"], "left")
        .select("id", "text", "ranges")
        .mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string")
        .withColumn("id", F.nullif("id", F.lit(_NO_ID)))
    )
