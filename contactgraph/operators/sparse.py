"""Sparse vectors ``(i, value)`` and matrices ``(i, j, value)`` as DataFrames.

A product is an equi-join on the shared index and a grouped sum, so Spark sums
each task's share before the shuffle. Adaptive execution splits the partition of
a hot index (see ``hot_join``). A matrix product, where a hot index multiplies
rows, is split by counts. With ``exact=True`` a sum is the same to the last bit
however the rows are spread (see ``exact_sum``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgraph.functions.joins import hot_join
from contactgraph.functions.sums import exact_sum
from contactgraph.session import cut_lineage, spread

# Entries of each side that meet in one cell of an all-with-all grid.
_SIDE = 4_000
# Hot indices listed by value and broadcast; beyond that they are joined.
_LISTED = 100_000


@dataclass(frozen=True)
class SparseVec:
    """Stored entries ``(i, value)`` of a vector with ``size`` places."""

    df: DataFrame
    size: int


@dataclass(frozen=True)
class SparseMat:
    """Stored entries ``(i, j, value)`` of an ``n_rows`` by ``n_cols`` matrix."""

    df: DataFrame
    n_rows: int
    n_cols: int

    @property
    def size(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols


def vector_from_df(df: DataFrame, size: int, i: str = "i", value: str = "value") -> SparseVec:
    cols = [F.col(i).cast("long").alias("i"), F.col(value).cast("double").alias("value")]
    return SparseVec(df.select(*cols), size)


def matrix_from_df(
    df: DataFrame, n_rows: int, n_cols: int, i: str = "i", j: str = "j", value: str = "value"
) -> SparseMat:
    cols = [F.col(c).cast("long").alias(n) for c, n in ((i, "i"), (j, "j"))]
    return SparseMat(df.select(*cols, F.col(value).cast("double").alias("value")), n_rows, n_cols)


def _keys(x: SparseVec | SparseMat) -> list[str]:
    return ["i"] if isinstance(x, SparseVec) else ["i", "j"]


def validate(x: SparseVec | SparseMat) -> None:
    """Raise when an index is outside the declared size or stored twice."""
    limits = {"i": x.size} if isinstance(x, SparseVec) else {"i": x.n_rows, "j": x.n_cols}
    outside = F.lit(False)
    for name, limit in limits.items():
        outside = outside | (F.col(name) < 0) | (F.col(name) >= limit)
    bad = (
        x.df.groupBy(*_keys(x))
        .agg(F.count("*").alias("copies"))
        .agg(F.count_if(outside), F.count_if(F.col("copies") > 1))
        .first()
    )
    if bad[0]:
        raise ValueError(f"{bad[0]} indices outside the declared size {limits}")
    if bad[1]:
        raise ValueError(f"{bad[1]} indices stored more than once")


def coalesce(x: SparseVec | SparseMat, exact: bool = False) -> SparseVec | SparseMat:
    """Sum entries stored under the same index."""
    if exact:
        return _with_df(x, exact_sum(x.df, *_keys(x)))
    return _with_df(x, x.df.groupBy(*_keys(x)).agg(F.sum("value").alias("value")))


def _with_df(x, df: DataFrame):
    if isinstance(x, SparseVec):
        return SparseVec(df, x.size)
    return SparseMat(df, x.n_rows, x.n_cols)


def _need(kind: type, *args) -> None:
    for arg in args:
        if not isinstance(arg, kind):
            raise TypeError(f"expected {kind.__name__}, got {type(arg).__name__}")


def _same(left, right) -> None:
    if left != right:
        raise ValueError(f"size mismatch: {left} and {right}")


def _summed(df: DataFrame, *keys: str, exact: bool = False) -> DataFrame:
    sums = exact_sum(df, *keys) if exact else df.groupBy(*keys).agg(F.sum("value").alias("value"))
    return sums.filter(F.col("value") != 0)


def _piece(key: str, count: Column) -> Column:
    return F.pmod(F.xxhash64(key), count.cast("long"))


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))


# vectors


def vec_repeat(spark: SparkSession, value: float, size: int) -> SparseVec:
    """``value`` at every index 0..size-1."""
    entries = spark.range(size).select(
        F.col("id").alias("i"), F.lit(float(value)).alias("value")
    )
    return SparseVec(entries, size)


def vec_constant_on(ids: DataFrame, value: float, size: int, id_col: str = "id") -> SparseVec:
    """``value`` at the indices found in ``ids``."""
    return vector_from_df(ids.withColumn("_value", F.lit(float(value))), size, id_col, "_value")


def vec_apply(v: SparseVec, fn: Callable[[Column], Column]) -> SparseVec:
    """Map the stored values; absent entries stay absent."""
    _need(SparseVec, v)
    return SparseVec(v.df.select("i", fn(F.col("value")).cast("double").alias("value")), v.size)


def mat_apply(a: SparseMat, fn: Callable[[Column], Column]) -> SparseMat:
    _need(SparseMat, a)
    return _with_df(a, a.df.select("i", "j", fn(F.col("value")).cast("double").alias("value")))


def vec_dot(u: SparseVec, v: SparseVec, exact: bool = False) -> DataFrame:
    """One row ``(value)``; 0.0 when no index is stored on both sides."""
    _need(SparseVec, u, v)
    _same(u.size, v.size)
    both = u.df.join(v.df.select("i", F.col("value").alias("other")), "i")
    terms = both.select((F.col("value") * F.col("other")).alias("value"))
    total = exact_sum(terms) if exact else terms.agg(F.sum("value").alias("value"))
    return total.select(F.coalesce("value", F.lit(0.0)).alias("value"))


def _signed_sum(u: SparseVec, v: SparseVec, right: Column) -> SparseVec:
    _need(SparseVec, u, v)
    _same(u.size, v.size)
    stacked = u.df.unionByName(v.df.select("i", right.alias("value")))
    return SparseVec(stacked.groupBy("i").agg(F.sum("value").alias("value")), u.size)


def vec_add(u: SparseVec, v: SparseVec) -> SparseVec:
    return _signed_sum(u, v, F.col("value"))


def vec_sub(u: SparseVec, v: SparseVec) -> SparseVec:
    """``u - v``, an absent entry counting as 0."""
    return _signed_sum(u, v, -F.col("value"))


def vec_hadamard(u: SparseVec, v: SparseVec) -> SparseVec:
    """Element-wise product, zeros dropped."""
    _need(SparseVec, u, v)
    _same(u.size, v.size)
    both = u.df.join(v.df.select("i", F.col("value").alias("other")), "i")
    product = both.select("i", (F.col("value") * F.col("other")).alias("value"))
    return SparseVec(product.filter(F.col("value") != 0), u.size)


def vec_outer(u: SparseVec, v: SparseVec, side: int = _SIDE) -> SparseMat:
    """Outer product, zeros dropped.

    The result has an entry per pair, so it is laid out as a grid: each vector
    is hashed into pieces of about ``side`` stored entries, copied to the cells
    of its row or column of the grid, and joined on the cell. A vector of at most
    ``side`` entries is one piece, and then the other one is not copied at all.
    Writes both vectors and counts them.
    """
    _need(SparseVec, u, v)
    stored = F.col("value") != 0
    left, right = cut_lineage(u.df.filter(stored)), cut_lineage(v.df.filter(stored))
    n_left, n_right = left.count(), right.count()
    rows = max(1, -(-n_left // side))
    cols = max(1, -(-n_right // side))

    left = left.select(
        "i",
        "value",
        _piece("i", F.lit(rows)).alias("cell_row"),
        _every(F.lit(cols)).alias("cell_col"),
    )
    right = right.select(
        F.col("i").alias("j"),
        F.col("value").alias("other"),
        _piece("i", F.lit(cols)).alias("cell_col"),
        _every(F.lit(rows)).alias("cell_row"),
    )
    laid = spread(left, "cell_row", "cell_col", rows=n_left * n_right)
    product = laid.join(right, ["cell_row", "cell_col"]).select(
        "i", "j", (F.col("value") * F.col("other")).alias("value")
    )
    return SparseMat(product.filter(F.col("value") != 0), u.size, v.size)


def vec_mat(v: SparseVec, a: SparseMat, exact: bool = False) -> SparseVec:
    """Row vector times matrix, zeros dropped."""
    _need(SparseVec, v)
    _need(SparseMat, a)
    _same(v.size, a.n_rows)
    terms = hot_join(a.df, v.df.select("i", F.col("value").alias("other")), "i").select(
        F.col("j").alias("i"), (F.col("value") * F.col("other")).alias("value")
    )
    return SparseVec(_summed(terms, "i", exact=exact), a.n_cols)


# matrices


def mat_transpose(a: SparseMat) -> SparseMat:
    _need(SparseMat, a)
    swapped = a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return SparseMat(swapped, a.n_cols, a.n_rows)


def _hot_indices(a: SparseMat, b: SparseMat, side: int) -> tuple[DataFrame | None, bool]:
    """``(k, cell_rows, cell_cols)`` for shared indices whose product has more
    than side*side terms, None when there are none; and whether it is short
    enough to be broadcast."""
    left = a.df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("rows"))
    right = b.df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("cols"))
    hot = (
        left.join(right, "k")
        .filter(F.col("rows").cast("double") * F.col("cols") > float(side * side))
        .select(
            "k",
            F.ceil(F.col("rows") / side).alias("cell_rows"),
            F.ceil(F.col("cols") / side).alias("cell_cols"),
        )
    )
    listed = hot.limit(_LISTED + 1).collect()
    if not listed:
        return None, True
    if len(listed) > _LISTED:
        return cut_lineage(hot), False
    schema = "k long, cell_rows long, cell_cols long"
    return F.broadcast(a.df.sparkSession.createDataFrame(listed, schema)), True


def mat_mul(a: SparseMat, b: SparseMat, side: int = _SIDE, exact: bool = False) -> SparseMat:
    """Matrix product, zeros dropped.

    The terms of a shared index are all pairs of its column in ``a`` and its
    row in ``b``. An index with more than side*side of them is cut into a grid
    of pieces, each met by copies of the other side, so no task forms them all.
    Writes both matrices once.
    """
    _need(SparseMat, a, b)
    _same(a.n_cols, b.n_rows)
    # read by the count of hot indices and by the product
    a, b = (SparseMat(cut_lineage(m.df), m.n_rows, m.n_cols) for m in (a, b))
    left = a.df.select("i", F.col("j").alias("k"), "value")
    right = b.df.select(F.col("i").alias("k"), "j", F.col("value").alias("other"))
    keys = ["k"]
    hot, listed = _hot_indices(a, b, side)
    if hot is not None:
        # a short list is broadcast; a long one meets hot indices on both sides
        joined = (lambda m: m.join(hot, "k", "left")) if listed else (lambda m: hot_join(m, hot, "k", "left"))
        rows = F.coalesce("cell_rows", F.lit(1))
        cols = F.coalesce("cell_cols", F.lit(1))
        keys = ["k", "cell_row", "cell_col"]
        left = joined(left).select(
            "i", "k", "value", _piece("i", rows).alias("cell_row"), _every(cols).alias("cell_col")
        )
        right = joined(right).select(
            "k", "j", "other", _every(rows).alias("cell_row"), _piece("j", cols).alias("cell_col")
        )
        left = spread(left, *keys)
    terms = left.join(right, keys).select(
        "i", "j", (F.col("value") * F.col("other")).alias("value")
    )
    return SparseMat(_summed(terms, "i", "j", exact=exact), a.n_rows, b.n_cols)


def mat_vec(a: SparseMat, v: SparseVec, exact: bool = False) -> SparseVec:
    """Matrix times column vector, zeros dropped."""
    _need(SparseMat, a)
    _need(SparseVec, v)
    _same(a.n_cols, v.size)
    right = v.df.select(F.col("i").alias("j"), F.col("value").alias("other"))
    terms = hot_join(a.df, right, "j").select(
        "i", (F.col("value") * F.col("other")).alias("value")
    )
    return SparseVec(_summed(terms, "i", exact=exact), a.n_rows)


def mat_diag(v: SparseVec) -> SparseMat:
    """Square matrix with ``v`` on the diagonal."""
    _need(SparseVec, v)
    return SparseMat(v.df.select("i", F.col("i").alias("j"), "value"), v.size, v.size)


def _scaled(a: SparseMat, v: SparseVec, key: str) -> SparseMat:
    factors = v.df.select(F.col("i").alias(key), F.col("value").alias("factor"))
    product = hot_join(a.df, factors, key).select(
        "i", "j", (F.col("value") * F.col("factor")).alias("value")
    )
    return _with_df(a, product.filter(F.col("value") != 0))


def mat_scale_cols(a: SparseMat, v: SparseVec) -> SparseMat:
    """``A · diag(v)`` as one join, zeros dropped."""
    _need(SparseMat, a)
    _need(SparseVec, v)
    _same(a.n_cols, v.size)
    return _scaled(a, v, "j")


def mat_scale_rows(v: SparseVec, a: SparseMat) -> SparseMat:
    """``diag(v) · A`` as one join, zeros dropped."""
    _need(SparseMat, a)
    _need(SparseVec, v)
    _same(a.n_rows, v.size)
    return _scaled(a, v, "i")


def mat_hadamard(a: SparseMat, b: SparseMat) -> SparseMat:
    """Element-wise product, zeros dropped."""
    _need(SparseMat, a, b)
    _same(a.size, b.size)
    both = a.df.join(b.df.select("i", "j", F.col("value").alias("other")), ["i", "j"])
    product = both.select("i", "j", (F.col("value") * F.col("other")).alias("value"))
    return _with_df(a, product.filter(F.col("value") != 0))


def matrix_rows(a: SparseMat, width: int = 4_096) -> DataFrame:
    """Local row pieces ``(i, block, cells)``, cells sorted by column.

    ``block`` is the column divided by ``width``, so no array holds more than
    ``width`` cells however long the row is.
    """
    _need(SparseMat, a)
    block = F.floor(F.col("j") / F.lit(width)).cast("long")
    return a.df.groupBy("i", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("j", "value"))).alias("cells")
    )
