"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest pivots in order of nearness. Inverted lists
hold, for each set of ``shared`` pivots, the vectors that have all of them among
their nearest; two vectors meet in a list exactly if they share that many. The
count of shared pivots decides in which list a pair is verified, so that each
pair is verified once, by the cosine in double precision.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.components import connected_components
from contactgraph.functions.joins import hot_join
from contactgraph.llm.runs import starts_of_runs, whole_runs
from contactgraph.session import cut_lineage

#: Pivots grow with the square root of the number of vectors, so that lists do not
#: grow with it, from the least number up to the most.
LEAST_PIVOTS, MOST_PIVOTS, PER_ROOT = 256, 4_096, 2
#: Vectors and components of the sample that pivots are drawn from, and their highest
#: cosine with each other; the pivots are all that is fitted.
SAMPLE, SAMPLE_VALUES, APART = 16_384, 2**23, 0.8
NEAREST, SHARED = 6, 2
#: Vectors of one list that one group compares; longer lists are cut.
BLOCK = 1_024
SEED = 5


def usable(vector: str | Column) -> Column:
    """Whether a vector has only finite components, and not only zeros."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, width)


def pivots_for(vectors: int) -> int:
    """The number of pivots for so many vectors."""
    return int(min(max(LEAST_PIVOTS, PER_ROOT * vectors**0.5), MOST_PIVOTS))


def fit_pivots(vectors: DataFrame, pivots: int, width: int, sample: int = SAMPLE, apart: float = APART) -> np.ndarray:
    """Unit rows: of the first ``sample`` distinct vectors in hash order (fewer if they
    are wide) the first ``pivots`` whose cosine with each one taken before is at most
    ``apart``. So a crowd of near-copies gives one pivot, not many that its members
    would list in any order."""
    bound = max(1, min(sample, 8 * pivots, SAMPLE_VALUES // max(width, 1)))
    # bounded by the sample
    rows = vectors.select("vector").orderBy(F.xxhash64(F.lit(SEED), "vector"), "vector").limit(bound).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    rows = unit(_matrix(rows["vector"].combine_chunks(), width))
    taken, free = [], np.ones(len(rows), bool)
    while free.any() and len(taken) < pivots:
        taken.append(int(np.argmax(free)))
        free &= rows @ rows[taken[-1]] <= apart
    return rows[taken]


def pivot_keys(pivots: np.ndarray, nearest: int, shared: int):
    """A function from unit rows to their nearest pivots, nearest first, and
    their list keys, one for each set of ``shared`` of them."""
    sets = np.array(list(combinations(range(nearest), shared)))

    def keys(rows: np.ndarray):
        near = np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :nearest]
        chosen = np.sort(near[:, sets], axis=2)
        code = np.zeros(chosen.shape[:2], np.int64)
        for k in range(shared):
            code = code * len(pivots) + chosen[:, :, k]
        return near, code

    return keys


def _compare(rows, near, weights, own, code, other, least, pivots, shared):
    """Verified pairs of one group: per row the weight of the rows linked with
    it, and links that span what these pairs connect.

    ``own`` is the part each row belongs to; where a group holds two parts only
    pairs across them count, the others being counted within their part. A pair
    counts if this list's pivots are the first ones that it shares.
    """
    last = code % pivots
    have = np.zeros((len(rows), last + 1))
    at, place = np.nonzero(near <= last)
    have[at, near[at, place]] = 1
    linked = (rows @ rows.T >= least) & (have @ have.T == shared)
    np.fill_diagonal(linked, False)
    if other:
        linked &= own[:, None] != own[None, :]
    degree = linked @ weights
    rest, left, right = np.ones(len(rows), bool), [], []
    for start in np.flatnonzero(linked.any(axis=1)):
        queue = [start] if rest[start] else []
        while queue:
            here = queue.pop()
            rest[here] = False
            found = np.flatnonzero(linked[here] & rest)
            rest[found] = False
            left += [here] * len(found)
            right += found.tolist()
            queue += found.tolist()
    return degree, left, right


_PAIRS = "a bigint, b bigint, links bigint"


def near_duplicates(
    table: DataFrame,
    least: float = 0.95,
    pivots: int | None = None,
    nearest: int = NEAREST,
    shared: int = SHARED,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``table``.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing, nor does a row without an id; vectors of another length than most
    are compared among their own length. Equal vectors are one vector with a
    weight. A list longer than ``block`` is cut by a hash into parts, and every
    two parts meet in a group of their own. Groups give sums of weights and
    spanning links, not pairs. Rows with one id count as one. Runs jobs.
    """
    # single precision stays so on the way, and is compared in double
    single = table.select(vector_col).schema[0].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    all_rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    good = all_rows.filter(F.col("id").isNotNull() & usable("vector"))
    # a copy is found by its least id, which stands for all of them
    copies = good.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    firsts = cut_lineage(copies.groupBy("vector").agg(F.min("id").alias("node"), F.count_distinct("id").alias("weight")))
    lengths = firsts.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()

    found = None
    for width, n in sorted(map(tuple, lengths)):
        same = firsts.filter(F.size("vector") == width)
        chosen = fit_pivots(same, pivots or pivots_for(n), width)
        part = _verified(same, width, kind, least, chosen, nearest, shared, block)
        found = part if found is None else found.union(part)
    if found is None:
        found = table.sparkSession.createDataFrame([], _PAIRS)
    found = cut_lineage(found)
    degrees = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("b is not null").select("a", "b"))
    named = (
        firsts.join(degrees, "node", "left")
        .join(roots, "node", "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    # the vectors are compared as wholes: equal ones found the same row above
    by_id = (
        hot_join(copies.withColumn("mark", F.xxhash64("vector")), named.withColumn("mark", F.xxhash64("vector")).withColumnRenamed("vector", "other"), "mark")
        .filter(F.col("vector") == F.col("other"))
        .groupBy("id")
        .agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    )
    return (
        all_rows.select("id")
        .join(by_id, "id", "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )


def _verified(firsts, width, kind, least, pivots, nearest, shared, block) -> DataFrame:
    """Rows ``(node, null, links)`` with sums of weights and ``(a, b, null)`` with links."""
    nearest = min(nearest, len(pivots))
    shared = min(shared, nearest)
    keys_of = pivot_keys(pivots, nearest, shared)

    def listed(values: np.ndarray, kind) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), kind), values.shape[1]).cast(pa.list_(kind))

    def listings(batches):
        for batch in batches:
            _, codes = keys_of(unit(_matrix(batch.column("vector"), width)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), listed(codes, pa.int64())], ["node", "codes"])

    def describe(batches):
        for batch in batches:
            near, _ = keys_of(unit(_matrix(batch.column("vector"), width)))
            columns = [batch.column(c) for c in ("node", "weight", "vector")]
            yield pa.RecordBatch.from_arrays([*columns, listed(near.astype(np.int32), pa.int32())], ["node", "weight", "vector", "near"])

    entries = firsts.select("node", "vector").mapInArrow(listings, "node bigint, codes array<bigint>")
    entries = entries.select("node", F.explode("codes").alias("code"))
    sizes = entries.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = (
        hot_join(entries, sizes, "code")
        .withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .select("node", "code", "lo", "hi", "own")
    )
    described = firsts.select("node", "weight", "vector").mapInArrow(
        describe, f"node bigint, weight bigint, vector array<{kind}>, near array<int>"
    )
    met = grouped.join(described, "node").select("code", "lo", "hi", "own", "node", "weight", "near", "vector")
    keys = ["code", "lo", "hi"]
    total = len(pivots)

    def verify(batches):
        for group in whole_runs(batches, keys):
            columns = [group[k].to_numpy() for k in keys]
            starts = starts_of_runs(columns)
            ends = np.append(starts[1:], group.num_rows)
            rows = unit(_matrix(group["vector"].combine_chunks(), width))
            near = group["near"].combine_chunks().flatten().to_numpy().reshape(-1, nearest)
            node, weight, own = (group[c].to_numpy() for c in ("node", "weight", "own"))
            links, sums = ([], []), ([], [])
            for i, j in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                code, lo, hi = (c[i] for c in columns)
                degree, a, b = _compare(
                    rows[i:j], near[i:j], weight[i:j], own[i:j], int(code), lo != hi, least, total, shared
                )
                some = np.flatnonzero(degree)
                sums[0].append(node[i:j][some])
                sums[1].append(degree[some])
                links[0].append(node[i:j][a])
                links[1].append(node[i:j][b])
            for a, b, n in ((*links, None), (sums[0], None, sums[1])):
                a = pa.array(np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64))
                columns_out = [
                    pa.nulls(len(a), pa.int64()) if x is None else pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
                    for x in (b, n)
                ]
                yield pa.RecordBatch.from_arrays([a, *columns_out], ["a", "b", "links"])

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, _PAIRS)
