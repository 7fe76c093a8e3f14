"""Matrices stored for many products: bucketed and sorted by the index that a
product joins on, so the matrix is shuffled when it is stored and never again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.operators.sparse import SparseMat, SparseVec, _need, _same, _summed
from contactgraph.session import cut_lineage, fresh_folder, partition_count

#: An index with more than this share of all entries, and more than HOT_ENTRIES, is
#: kept apart. Shares sum to one, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE, HOT_ENTRIES = 1e-5, 1_000_000


@dataclass(frozen=True)
class StoredMat:
    """A matrix in a table bucketed by ``key`` (``i`` or ``j``), and in another table
    the entries of its hot indices, which are listed in ``hot``."""

    table: str
    hot_table: str | None
    hot: DataFrame | None
    key: str
    n_rows: int
    n_cols: int

    def drop(self, spark) -> None:
        """Forget the tables; the files go with the shared folder."""
        for table in filter(None, (self.table, self.hot_table)):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def store(a: SparseMat, key: str, hot_entries: int = HOT_ENTRIES, buckets: int | None = None) -> StoredMat:
    """Write ``a`` below the shared folder in as many buckets of ``key`` as its
    entries take, not fewer than the session's shuffle partitions. The entries of
    an index with more than ``hot_entries`` of them would make one bucket long, so
    they are written as they come."""
    _need(SparseMat, a)
    if key not in ("i", "j"):
        raise ValueError(f"key must be 'i' or 'j', got {key!r}")
    spark = a.df.sparkSession
    entries = cut_lineage(a.df)
    counts = cut_lineage(entries.groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(hot_entries, int(total * HOT_SHARE))
    # bounded by 1 / HOT_SHARE, or by total / hot_entries
    listed = counts.filter(F.col("n") > limit).select(key).collect() if total > limit else []
    hot, hot_table = None, None
    if listed:
        hot = spark.createDataFrame(listed, f"{key} long")
        hot_table = f"hot_{uuid.uuid4().hex}"
        apart = entries.join(F.broadcast(hot), key, "left_semi")
        apart.write.option("path", fresh_folder(spark, "stored")).saveAsTable(hot_table)
        entries = entries.join(F.broadcast(hot), key, "left_anti")
    table = f"stored_{uuid.uuid4().hex}"
    n = buckets or partition_count(spark, total)
    # one file a bucket, so a bucket is read in order
    laid = entries.select("i", "j", "value").repartition(n, key)
    laid.write.bucketBy(n, key).sortBy(key).option("path", fresh_folder(spark, "stored")).saveAsTable(table)
    return StoredMat(table, hot_table, hot, key, a.n_rows, a.n_cols)


def _terms(a: StoredMat, v: SparseVec) -> DataFrame:
    """``(i, value)``: the stored entries times the vector at ``key``, by the other index."""
    spark = v.df.sparkSession
    values = v.df.select(F.col("i").alias(a.key), F.col("value").alias("other"))
    product = (F.col("i" if a.key == "j" else "j").alias("i"), (F.col("value") * F.col("other")).alias("value"))
    terms = spark.table(a.table).join(values, a.key).select(*product)
    if a.hot is not None:
        # bounded as the list of hot indices is
        at_hot = F.broadcast(values.join(F.broadcast(a.hot), a.key, "left_semi"))
        terms = terms.unionByName(spark.table(a.hot_table).join(at_hot, a.key).select(*product))
    return terms


def stored_mat_vec(a: StoredMat, v: SparseVec, exact: bool = False) -> SparseVec:
    """Matrix (stored by ``j``) times column vector, zeros dropped: the vector is
    shuffled to the buckets and the partial sums to their rows."""
    _need(StoredMat, a)
    _need(SparseVec, v)
    if a.key != "j":
        raise ValueError("a matrix stored by its columns is needed")
    _same(a.n_cols, v.size)
    return SparseVec(_summed(_terms(a, v), "i", exact=exact), a.n_rows)


def stored_vec_mat(v: SparseVec, a: StoredMat, exact: bool = False) -> SparseVec:
    """Row vector times matrix (stored by ``i``), zeros dropped."""
    _need(StoredMat, a)
    _need(SparseVec, v)
    if a.key != "i":
        raise ValueError("a matrix stored by its rows is needed")
    _same(a.n_rows, v.size)
    return SparseVec(_summed(_terms(a, v), "i", exact=exact), a.n_cols)
