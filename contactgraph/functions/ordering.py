"""Global order without a single-partition sort: exact k-th row, first k rows,
random k rows, dense row numbers, sums of the rows before, the next row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactgraph.functions.hashing import portable_uniform
from contactgraph.session import cut_lineage

# Largest k handed to orderBy().limit(k): every task keeps k rows and one task
# merges those of all tasks, so k is kept small. Above it the selection below
# works on counts only.
TOP_ROWS = 1_000
_SHARES = [(n + 1) / 64 for n in range(64)]


def _columns(keys) -> list[Column]:
    return [k if isinstance(k, Column) else F.col(k) for k in keys]


def _order_struct(keys) -> Column:
    return F.struct(*[c.alias(f"k{n}") for n, c in enumerate(_columns(keys))])


def _refuse_unordered(rows: DataFrame, names: list[str]) -> None:
    # NaN is not equal to itself as a number, but Spark orders it last
    odd = F.lit(False)
    for name in names:
        odd = odd | F.col(name).isNull() | F.isnan(F.col(name).cast("double"))
    if not rows.filter(odd).isEmpty():
        raise ValueError("keys must not be null or NaN")


def last_of_first(df: DataFrame, k: int, *keys, top_rows: int = TOP_ROWS) -> tuple | None:
    """Key tuple of the k-th row in ascending order of the numeric ``keys``,
    or of the last row when there are fewer; ``None`` when nothing is taken.

    ``keys`` together must be unique. Null and NaN keys are refused, whatever k
    is; infinite ones are in order like others. Small k is a top-k.
    Large k narrows the range by counts between quantiles, two scans with
    map-side aggregates per pass: no row is sorted or moved. Quantiles are taken
    of the values below the largest, so every pass shrinks the range, whatever
    the values, and a heavy value is alone after two.
    """
    if k < 0:
        raise ValueError(f"k must not be negative, got {k}")
    if k == 0:
        return None
    names = [f"k{n}" for n in range(len(keys))]
    rest = df.select(*[c.alias(n) for n, c in zip(names, _columns(keys))])
    _refuse_unordered(rest, names)
    found: list = []
    for depth, name in enumerate(names):
        open_names = names[depth:]
        while True:
            if k <= top_rows:
                last = (
                    rest.orderBy(*open_names)
                    .limit(k)
                    .agg(F.max(F.struct(*open_names)).alias("last"))
                    .first()["last"]
                )
                return None if last is None else tuple(found) + tuple(last)
            low, high, size = rest.agg(F.min(name), F.max(name), F.count("*")).first()
            if not size:
                return None
            k = min(k, size)
            if low == high:
                break
            below = F.when(F.col(name) < F.lit(high), F.col(name))
            quantiles = F.percentile_approx(below, _SHARES, 100 * len(_SHARES))
            bounds = sorted(set(rest.agg(quantiles).first()[0]))
            listed = F.array(*[F.lit(b) for b in bounds])
            bucket = F.size(F.filter(listed, lambda b: b < F.col(name)))
            # at most one row more than there are shares comes back
            counts = (
                rest.groupBy(bucket.alias("bucket"))
                .agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"))
                .orderBy("bucket")
                .collect()
            )
            for row in counts:
                if k <= row["n"]:
                    inside = F.col(name).between(F.lit(row["lo"]), F.lit(row["hi"]))
                    break
                k -= row["n"]
            rest = rest.filter(inside)
        found.append(low)
        rest = rest.filter(F.col(name) == F.lit(low))
    return tuple(found)


def at_or_before(keys, cut: tuple | None) -> Column:
    """Rows whose key tuple is not after ``cut``; none when ``cut`` is None."""
    if cut is None:
        return F.lit(False)
    bound = F.struct(*[F.lit(v).alias(f"k{n}") for n, v in enumerate(cut)])
    return _order_struct(keys) <= bound


def first_k(df: DataFrame, k: int, *keys, top_rows: int = TOP_ROWS) -> DataFrame:
    """The first k rows in ascending order of unique numeric ``keys``."""
    return df.filter(at_or_before(keys, last_of_first(df, k, *keys, top_rows=top_rows)))


def sample_k(df: DataFrame, k: int, seed, key: str = "id", top_rows: int = TOP_ROWS) -> DataFrame:
    """k rows drawn without replacement: the first k in hash order."""
    return first_k(df, k, portable_uniform(seed, key), F.col(key), top_rows=top_rows)


def dense_index(df: DataFrame, *keys, name: str = "idx") -> DataFrame:
    """Add 1-based row numbers in the order of unique ``keys``.

    Range partitions are sorted on their own, and the number of rows before
    each partition (one value per partition) is added. The placed rows are
    written once, so both passes see the same partitions even after a loss.
    """
    order = _columns(keys)
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    block = F.shiftright("_slot", 33)
    sizes = placed.groupBy(block.alias("_block")).agg(F.count("*").alias("n")).collect()
    starts, before = [], 1
    for row in sorted(sizes, key=lambda r: r["_block"]):
        starts.append((row["_block"], before))
        before += row["n"]
    # one row per partition
    offsets = df.sparkSession.createDataFrame(starts, "_block long, _start long")
    return (
        placed.withColumn("_block", block)
        .join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_start") + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_block", "_start", "_slot")
    )


def sum_before(df: DataFrame, keys: list[str], value: str, name: str = "before") -> DataFrame:
    """Add the sum of the whole-number column ``value`` over all rows before, in
    the order of unique ``keys``; null counts as 0.

    Rows are range-partitioned and sorted once and summed within their partition
    as they pass; one total per partition is added up on the driver. Sums must fit
    a long. Runs a job.
    """
    order = _columns(keys)
    ranged = df.withColumn("_value", F.coalesce(F.col(value).cast("long"), F.lit(0)))
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)

    def summed(batches):
        block, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = np.cumsum(batch.column("_value").to_numpy()) + before
            starts = ends - batch.column("_value").to_numpy()
            before = int(ends[-1]) if batch.num_rows else before
            blocks = pa.array(np.full(batch.num_rows, block, np.int32))
            columns = [*batch.columns, pa.array(starts, pa.int64()), blocks]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_before", "_block"])

    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in ranged.schema]
        + [T.StructField("_before", T.LongType()), T.StructField("_block", T.IntegerType())]
    )
    placed = cut_lineage(ranged.mapInArrow(summed, schema))
    totals, before = [], 0
    # one row per partition
    for row in sorted(placed.groupBy("_block").agg(F.sum("_value").alias("n")).collect()):
        totals.append((row["_block"], before))
        before += row["n"]
    offsets = df.sparkSession.createDataFrame(totals, "_block int, _offset long")
    joined = placed.join(F.broadcast(offsets), "_block")
    return joined.select(*df.columns, (F.col("_before") + F.col("_offset")).alias(name))


def with_next(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Each row but the last with the next row's ``cols`` as ``next_<col>``, in
    the order of unique ``keys``.

    Rows are range-partitioned and sorted once; within a partition the next row
    is the one after, and only the first row of every partition is passed to the
    partition before, on the driver. Runs a job.
    """
    order = _columns(keys)
    names = [f"next_{c}" for c in cols]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def shifted(batches):
        block = TaskContext.get().partitionId()

        def joined(batch, following, first):
            n = batch.num_rows
            edge = np.zeros(n, np.int8)
            edge[0] = first
            edge[n - 1] |= 2 * (following is None)
            nexts = []
            for c in cols:
                own = batch.column(c).slice(1)
                tail = pa.nulls(1, own.type) if following is None else following.column(c).slice(0, 1)
                nexts.append(pa.concat_arrays([own, tail]))
            blocks = pa.array(np.full(n, block, np.int32))
            return pa.RecordBatch.from_arrays(
                [*batch.columns, *nexts, blocks, pa.array(edge)],
                [*batch.schema.names, *names, "_block", "_edge"],
            )

        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield joined(held, batch, first)
                first = False
            held = batch
        if held is not None:
            yield joined(held, None, first)

    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in df.schema]
        + [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, cols)]
        + [T.StructField("_block", T.IntegerType()), T.StructField("_edge", T.ByteType())]
    )
    placed = cut_lineage(ranged.mapInArrow(shifted, schema))
    # one row per partition
    heads = placed.filter(F.col("_edge").bitwiseAND(F.lit(1)) == 1).select("_block", *cols).collect()
    heads.sort(key=lambda r: r["_block"])
    followers = [(a["_block"], *[b[c] for c in cols]) for a, b in zip(heads, heads[1:])]
    passed = T.StructType(
        [T.StructField("_block", T.IntegerType())]
        + [T.StructField(f"_{n}", df.schema[c].dataType) for n, c in zip(names, cols)]
    )
    table = df.sparkSession.createDataFrame(followers, passed)
    last = F.col("_edge") >= 2
    joined = placed.join(F.broadcast(table.withColumn("_known", F.lit(True))), "_block", "left")
    return joined.filter(~last | F.col("_known")).select(
        *df.columns, *[F.when(last, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names]
    )
