"""Hard negatives by search in STR-packed R-trees.

Vectors are whole numbers per component, so scores are whole inner products. All
rows are dealt to tiles by sort-tile-recursive splits, fitted on a bounded sample:
first by label, then by one coordinate after the other. Rows of a tile make
blocks of bounded size, and each block is packed into an R-tree: leaves of rows,
above them boxes of minima and maxima. A box and a query give an interval for
every coordinate's product, hence for the score. The search of a query takes boxes
from a queue, highest upper end first, and leaves out those outside its score
windows and those strictly below the k-th score so far; equal ones are opened,
since ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgraph.functions.joins import hot_join
from contactgraph.llm.runs import starts_of_runs
from contactgraph.session import cut_lineage

#: Rows that the splits into tiles are fitted on.
SAMPLE = 8_192
#: Components of a block, and of the queries that one task holds beside it.
BLOCK_VALUES = 2**19
#: Components of the boxes of all tiles, which every task holds.
DIRECTORY_VALUES = 2**22
LEAF, FAN = 32, 16
SEED = 12
_GROUP = 256  # queries whose bounds are computed together
_EXACT = 2**53
_LONG = 2**62


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and has only finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )


# splits


def _equal_cuts(values: np.ndarray, slabs: int) -> np.ndarray:
    """Values at which sorted ``values`` are cut into equal slabs; ties stay together."""
    ordered = np.sort(values)
    places = (np.arange(1, slabs) * len(ordered)) // slabs
    cuts = np.unique(ordered[places])
    return cuts[cuts > ordered[0]]


def _label_cuts(labels: np.ndarray, capacity: int) -> np.ndarray:
    """Labels at which a new slab starts: a label that fills a slab has its own,
    smaller ones share."""
    kinds, counts = np.unique(labels, return_counts=True)
    cuts, held = [], 0
    for kind, n in zip(kinds, counts):
        if held and (held >= capacity or n >= capacity):
            cuts.append(kind)
            held = 0
        held += n
    return np.array(cuts, np.int64)


class Splits:
    """Sort-tile-recursive splits of labelled vectors into tiles of about
    ``capacity`` of the rows they are fitted on."""

    def __init__(self, labels: np.ndarray, vectors: np.ndarray, capacity: int):
        self.tiles = 0
        capacity = max(1, capacity)
        cuts = _label_cuts(labels, capacity)
        slab = np.searchsorted(cuts, labels, side="right")
        self.root = (-1, cuts, [self._fit(vectors[slab == s], capacity) for s in range(len(cuts) + 1)])

    def _fit(self, vectors: np.ndarray, capacity: int, used: frozenset = frozenset()):
        left = vectors.shape[1] - len(used)
        tiles = -(-len(vectors) // capacity)
        if tiles > 1 and left:
            slabs = 2
            while slabs**left < tiles:
                slabs += 1
            # wide coordinates first
            spread = np.ptp(vectors, axis=0).astype(np.float64)
            spread[list(used)] = -1.0
            at = int(np.argmax(spread))
            cuts = _equal_cuts(vectors[:, at], slabs)
            if len(cuts):
                part = np.searchsorted(cuts, vectors[:, at], side="right")
                below = used | {at}
                return at, cuts, [self._fit(vectors[part == p], capacity, below) for p in range(len(cuts) + 1)]
        self.tiles += 1
        return self.tiles - 1

    def assign(self, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The tile of every row."""
        found = np.zeros(len(labels), np.int64)
        open_nodes = [(self.root, np.arange(len(labels)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if not isinstance(node, tuple):
                found[rows] = node
                continue
            at, cuts, below = node
            part = np.searchsorted(cuts, labels[rows] if at < 0 else vectors[rows, at], side="right")
            open_nodes += [(child, rows[part == p]) for p, child in enumerate(below)]
        return found


# boxes and trees


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers in which their inner products come out exactly."""
    width = max(a.shape[1], 1)
    most = [max((abs(int(f(x))) for f in (np.min, np.max)), default=0) if x.size else 0 for x in (a, b)]
    top = width * most[0] * most[1]
    kind = np.float64 if top < _EXACT and max(most) < _EXACT else np.int64 if top < _LONG else object
    return a.astype(kind), b.astype(kind)


def interval(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with a vector in each box:
    every coordinate at the end of its interval that is worst, or best."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Tree:
    """A packed R-tree. Nodes are numbered from the leaves up, the root is last;
    ``first`` and ``last`` bound the rows of a leaf and the nodes below any other."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        tiles = Splits(labels, vectors, leaf).assign(labels, vectors)
        order = np.lexsort((ids, tiles))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        starts = starts_of_runs([tiles[order]])
        self.leaves = len(starts)
        low = high = self.vectors
        low_label = high_label = self.labels
        # of what a level's nodes hold, rows or nodes: how many there are, and the first's number
        size, offset, number, levels = len(order), 0, 0, []
        while True:
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            low_label, high_label = np.minimum.reduceat(low_label, starts), np.maximum.reduceat(high_label, starts)
            ends = np.append(starts[1:], size)
            levels.append((offset + starts, offset + ends, low, high, low_label, high_label))
            size = len(starts)
            if size == 1:
                break
            offset, number = number, number + size
            starts = np.arange(0, size, fan)
        self.first, self.last, self.low, self.high, self.low_label, self.high_label = map(np.concatenate, zip(*levels))

    def search(self, scores_of, low, high, fits, admitted, windows, k: int, stats: list | None = None) -> list[list]:
        """Per window the best ``k`` rows as ``(score, -id)``, best first.

        ``low`` and ``high`` are a query's score interval of every node, ``fits``
        says which nodes may hold rows of a wanted label, ``scores_of`` and
        ``admitted`` give the scores of a range of rows and whether they count.
        """
        best: list[list] = [[] for _ in windows]
        floors, tops = [w[0] for w in windows], [w[1] for w in windows]
        root = len(self.first) - 1
        queue = [(-high[root], root)] if fits[root] else []
        while queue:
            key, node = heapq.heappop(queue)
            if -key < min(floors):
                break
            if not any(-key >= f and low[node] <= t for f, t in zip(floors, tops)):
                continue
            i, j = self.first[node], self.last[node]
            if node >= self.leaves:
                for child in range(i, j):
                    if fits[child] and high[child] >= min(floors) and low[child] <= max(tops):
                        heapq.heappush(queue, (-high[child], child))
                continue
            if stats is not None:
                stats.append(node)
            scores = scores_of(i, j)
            some = np.flatnonzero((scores >= min(floors)) & (scores <= max(tops)) & admitted(i, j))
            for score, place in zip(scores[some].tolist(), self.ids[i:j][some].tolist()):
                entry = (int(score), -place)
                for w, found in enumerate(best):
                    if not floors[w] <= score <= tops[w]:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
                    if len(found) == k:
                        floors[w] = found[0][0]
        return [sorted(found, reverse=True) for found in best]


# search on Spark


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)


def _fit_tiles(index: DataFrame, rows: int, sample: int, block_values: int) -> dict[int, Splits]:
    """Splits for each width that the sample has."""
    # bounded by the sample
    taken = index.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample).select("label", "vector").collect()
    by_width: dict[int, list] = {}
    for r in taken:
        by_width.setdefault(len(r["vector"]), []).append(r)
    found = {}
    for width, some in by_width.items():
        share = rows * len(some) / len(taken)
        tiles = min(max(1, share * max(width, 1) / block_values), max(1, DIRECTORY_VALUES / (2 * max(width, 1) * len(by_width))))
        labels = np.array([r["label"] for r in some], np.int64)
        vectors = np.array([r["vector"] for r in some], np.int64).reshape(len(some), width)
        found[width] = Splits(labels, vectors, int(-(-len(some) // tiles)))
    return found


def _tiled(index: DataFrame, splits: dict[int, Splits], kind: str) -> DataFrame:
    """``index`` with ``width`` and ``tile``."""

    def run(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            tiles = np.zeros(len(widths), np.int64)
            labels = batch.column("label").to_numpy()
            for width in np.unique(widths):
                if width in splits:
                    at = np.flatnonzero(widths == width)
                    tiles[at] = splits[width].assign(labels[at], _matrix(batch.column("vector").take(pa.array(at)), width))
            yield batch.append_column("tile", pa.array(tiles))

    schema = f"id bigint, label bigint, vector array<{kind}>, width int, tile bigint"
    return index.select("id", "label", "vector", F.size("vector").alias("width")).mapInArrow(run, schema)


def _box(table: pa.Table, width: int, names: tuple) -> tuple:
    low, high = (_matrix(table[c], width) for c in names)
    return low.min(axis=0), high.max(axis=0)


_BOXES = "width int, tile bigint, n bigint, low array<bigint>, high array<bigint>, low_label bigint, high_label bigint"


def _boxes(tiled: DataFrame) -> DataFrame:
    """The box, the labels and the rows of each tile: every task sends one row per tile."""

    def row(width, tile, n, low, high, low_label, high_label):
        values = ([width], [tile], [n], [low], [high], [low_label], [high_label])
        types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
        names = ("width", "tile", "n", "low", "high", "low_label", "high_label")
        return pa.table([pa.array(v, t) for v, t in zip(values, types)], names=names)

    def own(batches):
        held: dict[tuple, tuple] = {}
        for batch in batches:
            widths, tiles, labels = (batch.column(c).to_numpy() for c in ("width", "tile", "label"))
            order = np.lexsort((tiles, widths))
            starts = starts_of_runs([widths[order], tiles[order]])
            for i, j in zip(starts, np.append(starts[1:], len(order))):
                at = order[i:j]
                key = (int(widths[at[0]]), int(tiles[at[0]]))
                vectors = _matrix(batch.column("vector").take(pa.array(at)), key[0])
                new = (len(at), vectors.min(axis=0), vectors.max(axis=0), int(labels[at].min()), int(labels[at].max()))
                old = held.get(key)
                held[key] = new if old is None else (
                    old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]), min(old[3], new[3]), max(old[4], new[4])
                )
        for key, values in held.items():
            yield from row(*key, *values).to_batches()

    def merged(table):
        low, high = _box(table, table["width"][0].as_py(), ("low", "high"))
        return row(
            table["width"][0].as_py(), table["tile"][0].as_py(), sum(table["n"].to_pylist()), low, high,
            min(table["low_label"].to_pylist()), max(table["high_label"].to_pylist()),
        )

    return tiled.mapInArrow(own, _BOXES).groupBy("width", "tile").applyInArrow(merged, _BOXES)


class _Directory:
    """Boxes of the tiles of one width, with the number of blocks of each."""

    def __init__(self, rows: list, width: int):
        self.tiles, self.blocks = (np.array([r[c] for r in rows], np.int64) for c in ("tile", "blocks"))
        self.low, self.high = (np.array([r[c] for r in rows], np.int64).reshape(len(rows), width) for c in ("low", "high"))
        self.low_label, self.high_label = (np.array([r[c] for r in rows], np.int64) for c in ("low_label", "high_label"))


def _label_fits(low: np.ndarray, high: np.ndarray, label: int, same: bool) -> np.ndarray:
    return (low <= label) & (label <= high) if same else ~((low == label) & (high == label))


_QUERY = "width int, tile bigint, part int, chunk int, a bigint, id bigint, label bigint, vector array<{0}>, low array<bigint>, high array<bigint>"


def _routed(queries: DataFrame, directory: dict[int, _Directory], same: bool, chunks: int, kind: str) -> DataFrame:
    """Each query once for every block that its labels and windows allow."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _GROUP):
                some = batch.slice(start, _GROUP)
                widths = some.column("width").to_numpy()
                labels, numbers = some.column("label").to_numpy(), some.column("a").to_numpy()
                lows, highs = some.column("low").to_pylist(), some.column("high").to_pylist()
                at, tiles, parts = [], [], []
                for width in np.unique(widths):
                    known = directory.get(int(width))
                    rows = np.flatnonzero(widths == width)
                    if known is None:
                        continue
                    vectors = _matrix(some.column("vector").take(pa.array(rows)), int(width))
                    vectors, boxes = exact(vectors, np.concatenate([known.low, known.high]))
                    least, most = interval(vectors, *np.split(boxes, 2))
                    for q, row in enumerate(rows):
                        fits = _label_fits(known.low_label, known.high_label, labels[row], same)
                        inside = np.zeros(len(fits), bool)
                        for lo, hi in zip(lows[row], highs[row]):
                            inside |= (most[q] >= lo) & (least[q] <= hi)
                        hit = np.flatnonzero(fits & inside)
                        counts = known.blocks[hit]
                        tiles.append(np.repeat(known.tiles[hit], counts))
                        parts.append(np.concatenate([np.arange(c) for c in counts]) if len(hit) else np.zeros(0, np.int64))
                        at.append(np.full(counts.sum(), row))
                if not at:
                    continue
                at = pa.array(np.concatenate(at))
                taken = pa.RecordBatch.from_arrays(some.columns, some.schema.names).take(at)
                extra = {
                    "tile": pa.array(np.concatenate(tiles).astype(np.int64)),
                    "part": pa.array(np.concatenate(parts).astype(np.int32)),
                    "chunk": pa.array((numbers[at.to_numpy()] % chunks).astype(np.int32)),
                }
                names = ["width", "tile", "part", "chunk", "a", "id", "label", "vector", "low", "high"]
                yield pa.RecordBatch.from_arrays([extra[n] if n in extra else taken.column(n) for n in names], names)

    return queries.select("width", "a", "id", "label", "vector", "low", "high").mapInArrow(run, _QUERY.format(kind))


_KEYS = ["width", "tile", "part", "chunk"]
_FOUND = "a bigint, p int, id bigint, score bigint"


def _searched(blocks: DataFrame, routed: DataFrame, k: int, same: bool) -> DataFrame:
    """``(a, p, id, score)``: per query ``a`` and window number ``p`` the best ``k``
    rows of each block, queries and rows of a block being cogrouped."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if rows.num_rows and asked.num_rows:
            width = rows["width"][0].as_py()
            vectors, queries = _matrix(rows["vector"], width), _matrix(asked["vector"], width)
            tree = Tree(rows["id"].to_numpy(), rows["label"].to_numpy(), vectors)
            vectors, queries = exact(tree.vectors, queries)
            boxes = [b.astype(vectors.dtype) for b in (tree.low, tree.high)]
            numbers, own, labels = (asked[c].to_numpy() for c in ("a", "id", "label"))
            windows = [list(zip(lo, hi)) for lo, hi in zip(asked["low"].to_pylist(), asked["high"].to_pylist())]
            for start in range(0, len(queries), _GROUP):
                least, most = interval(queries[start : start + _GROUP], *boxes)
                for q in range(start, min(start + _GROUP, len(queries))):
                    query, label, me = queries[q], labels[q], own[q]

                    def scores_of(i, j, query=query):
                        return vectors[i:j] @ query

                    def admitted(i, j, label=label, me=me):
                        return ((tree.labels[i:j] == label) == same) & (tree.ids[i:j] != me)

                    fits = _label_fits(tree.low_label, tree.high_label, label, same)
                    found = tree.search(
                        scores_of, least[q - start].tolist(), most[q - start].tolist(), fits, admitted, windows[q], k
                    )
                    for p, best in enumerate(found):
                        out[0].extend([numbers[q]] * len(best))
                        out[1].extend([p] * len(best))
                        out[2].extend(-i for _, i in best)
                        out[3].extend(min(max(s, -(2**63)), 2**63 - 1) for s, _ in best)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(o, t) for o, t in zip(out, types)], names=["a", "p", "id", "score"])

    return blocks.groupBy(*_KEYS).cogroup(routed.groupBy(*_KEYS)).applyInArrow(run, _FOUND)


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best ``k`` of each group, with their ``rank`` from 1; tasks keep no more each."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    table: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str | Column = "label",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)``. An anchor (``anchors`` is a condition
    on ``id``) is compared with all rows of its length: its positives are its best
    ``positives`` other rows of its label; for each of them come its best
    ``negatives`` rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's, both ends included. Equal scores go by the smaller id.

    Rows without an id or a label, and those whose vector is null or holds null or
    non-finite components, take no part; a row that came several times counts
    once; rows of one id with different contents are rows of their own, but none
    is a positive or negative to its own id. Of rows with equal vector and label
    only the first ids can be in a result, so only these are indexed, however
    many there are. Scaled components and scores beyond 64 bits stop at its ends.
    Anchors are copied to the blocks that their labels and windows allow, rows once
    for each chunk of anchors. Runs jobs.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    scaled = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = (
        table.filter(usable(vector_col))
        .select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled.alias("vector"))
        .filter("id is not null and label is not null")
    )
    rows = cut_lineage(rows.distinct())
    n, top, width = rows.agg(
        F.count("*"), F.max(F.array_max(F.transform("vector", lambda x: F.greatest(x, -1 - x)))), F.max(F.size("vector"))
    ).first()
    kind = "int" if (top or 0) < 2**31 else "bigint"
    rows = rows.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))

    alike = Window.partitionBy("label", "vector").orderBy("id")
    keep = max(positives + 1, negatives)
    index = cut_lineage(rows.withColumn("copy", F.row_number().over(alike)).filter(F.col("copy") <= keep).drop("copy"))
    tiled = _tiled(index, _fit_tiles(index, n, sample, block_values), kind)
    per_block = F.greatest(F.lit(1), F.floor(F.lit(block_values) / F.greatest("width", F.lit(1))))
    boxes = cut_lineage(_boxes(tiled).withColumn("blocks", F.ceil(F.col("n") / per_block).cast("int")))
    # bounded: a tile for so many rows of the sample, see DIRECTORY_VALUES
    listed: dict[int, list] = {}
    for r in boxes.collect():
        listed.setdefault(r["width"], []).append(r)
    directory = {w: _Directory(some, w) for w, some in listed.items()}

    asking = cut_lineage(rows.filter(anchors).withColumn("width", F.size("vector")).withColumn("a", F.monotonically_increasing_id()))
    chunks = max(1, -(-asking.count() * max(width or 1, 1) // block_values))
    key = F.concat_ws(":", "width", "tile")
    blocks = (
        hot_join(tiled.withColumn("key", key), boxes.select(key.alias("key"), "blocks"), "key")
        .withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .select(*_KEYS, "id", "label", "vector")
    )
    everything = [F.array(F.lit(v).cast("bigint")).alias(c) for c, v in (("low", -(2**63)), ("high", 2**63 - 1))]
    nearest = _searched(blocks, _routed(asking.select("*", *everything), directory, True, chunks, kind), positives, True)
    chosen = cut_lineage(_first(nearest, positives, "a").select("a", (F.col("rank") - 1).alias("p"), "id", "score"))

    # whole percents of a negative score are an empty window
    share = F.col("score").cast("decimal(38,0)")
    window = F.struct(
        "p",
        F.ceil(share * low / 100).cast("bigint").alias("low"),
        F.floor(share * high / 100).cast("bigint").alias("high"),
    )
    windows = chosen.groupBy("a").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    asked = asking.join(windows, "a").select(
        *asking.columns, F.col("windows.low").alias("low"), F.col("windows.high").alias("high")
    )
    found = _searched(blocks, _routed(asked, directory, False, chunks, kind), negatives, False)
    ranked = _first(found, negatives, "a", "p").select("a", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = chosen.select("a", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = pairs.join(asking.select("a", F.col("id").alias("anchor_id")), "a")
    return ranked.join(named, ["a", "p"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
