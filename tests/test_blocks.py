"""Matrices in blocks and in buckets, and sums that do not depend on the order."""

import random

import numpy as np
import pytest
from networks import make, plan_lines
from pyspark.sql import functions as F

from contactgraph import session
from contactgraph.functions.ordering import first_k
from contactgraph.operators import blocks, sparse, stored
from contactgraph.operators.graph import walk_rank
from contactgraph.plans import catalog
from contactgraph.sources import tables


def random_matrix(spark, rows, cols, n, seed, hot=None):
    rng = np.random.default_rng(seed)
    dense = np.zeros((rows, cols))
    dense[rng.integers(0, rows, n), rng.integers(0, cols, n)] = rng.integers(1, 9, n)
    if hot is not None:
        dense[hot] = rng.integers(1, 9, dense[hot].shape)
    i, j = np.nonzero(dense)
    entries = list(zip(i.tolist(), j.tolist(), dense[i, j].tolist()))
    return dense, sparse.SparseMat(spark.createDataFrame(entries, "i long, j long, value double"), rows, cols)


def dense_of(m):
    out = np.zeros(m.size)
    for r in m.df.collect():
        out[r["i"], r["j"]] += r["value"]
    return out


@pytest.mark.parametrize("side", [1, 7, 16, 64])
def test_blocks_and_back(spark, side):
    dense, a = random_matrix(spark, 50, 33, 300, seed=side)
    laid = blocks.to_blocks(a, side)
    assert np.array_equal(dense_of(blocks.from_blocks(laid)), dense)
    turned = blocks.block_transpose(laid)
    assert (turned.n_rows, turned.n_cols) == (33, 50)
    assert np.array_equal(dense_of(blocks.from_blocks(turned)), dense.T)
    assert laid.df.filter((F.size("cols") > side * side) | (F.size("starts") != side + 1)).count() == 0


@pytest.mark.parametrize("side", [5, 16, 100])
def test_block_products(spark, side):
    x, a = random_matrix(spark, 40, 60, 500, seed=1, hot=(slice(None), 3))
    y, b = random_matrix(spark, 60, 30, 400, seed=2, hot=(3, slice(None)))
    product = blocks.block_mul(blocks.to_blocks(a, side), blocks.to_blocks(b, side))
    assert product.size == (40, 30)
    assert np.array_equal(dense_of(product), x @ y)


def test_blocks_send_fewer_rows_than_terms(spark):
    _, a = random_matrix(spark, 60, 400, 6_000, seed=3)
    _, b = random_matrix(spark, 400, 60, 6_000, seed=4)
    left = a.df.select("i", F.col("j").alias("k"))
    terms = left.join(b.df.select(F.col("i").alias("k"), "j"), "k").count()
    sent = blocks.block_terms(blocks.to_blocks(a, 64), blocks.to_blocks(b, 64)).count()
    assert sent < terms / 2


def test_blocks_of_odd_matrices(spark):
    empty = sparse.SparseMat(spark.createDataFrame([], "i long, j long, value double"), 3, 4)
    laid = blocks.to_blocks(empty, 2)
    assert blocks.from_blocks(laid).df.count() == 0
    assert blocks.block_mul(laid, blocks.to_blocks(sparse.mat_transpose(empty), 2)).df.count() == 0
    twice = sparse.SparseMat(spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (0, 0, 1.0), (0, 0, -1.0)], empty.df.schema), 2, 2)
    assert {(r["i"], r["j"]): r["value"] for r in blocks.from_blocks(blocks.to_blocks(twice, 2)).df.collect()} == {(0, 1): 5.0, (0, 0): 0.0}
    with pytest.raises(ValueError):
        blocks.block_mul(laid, laid)
    with pytest.raises(ValueError):
        blocks.to_blocks(empty, 0)
    with pytest.raises(TypeError):
        blocks.block_mul(empty, empty)


def test_coalesced_entries_are_not_summed_again(spark, small):
    def sums(df):
        return sum("HashAggregate" in line for line in plan_lines(df))

    _, a = random_matrix(spark, 50, 33, 300, seed=8)
    twice = sparse.SparseMat(a.df.union(a.df), 50, 33)
    once = sparse.coalesce(twice)
    laid = blocks.to_blocks(once, 16, coalesced=True)
    assert sums(laid.df) == sums(once.df)
    assert np.array_equal(dense_of(blocks.from_blocks(laid)), 2 * dense_of(a))
    assert np.array_equal(dense_of(blocks.from_blocks(blocks.to_blocks(twice, 16))), 2 * dense_of(a))
    assert sums(catalog.block_matrix(spark, small)) == sums(tables.purchases(spark, small).df)


def test_many_order_lines_are_spread_by_count(spark, small, monkeypatch):
    def spread_to(df):
        return [line.split("(l_orderkey")[1].split("),")[0] for line in plan_lines(df) if "REPARTITION_BY_NUM" in line]

    few = catalog.block_matrix(spark, small)
    assert spread_to(few) == []
    monkeypatch.setattr(tables, "MANY_LINES", 1_000)
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 1_000)
    many = catalog.block_matrix(spark, small)
    lines = tables.load(spark, small, "lineitem").count()
    (found,) = spread_to(many)
    assert found.endswith(f", {-(-lines // 1_000)}")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


@pytest.mark.parametrize("hot_entries", [10, 1_000_000])
def test_stored_matrices(spark, hot_entries):
    x, a = random_matrix(spark, 40, 60, 500, seed=5, hot=(slice(None), 3))
    rng = np.random.default_rng(6)
    u, v = rng.integers(1, 5, 40).astype(float), rng.integers(1, 5, 60).astype(float)
    vector = {n: sparse.SparseVec(spark.createDataFrame(list(enumerate(w.tolist())), "i long, value double"), n) for n, w in ((40, u), (60, v))}
    by_col, by_row = stored.store(a, "j", hot_entries), stored.store(a, "i", hot_entries)
    assert (by_col.hot is None) == (hot_entries > 1_000)
    found = {r["i"]: r["value"] for r in stored.stored_mat_vec(by_col, vector[60]).df.collect()}
    assert found == {i: t for i, t in enumerate(x @ v) if t}
    found = {r["i"]: r["value"] for r in stored.stored_vec_mat(vector[40], by_row, exact=True).df.collect()}
    assert found == {i: t for i, t in enumerate(u @ x) if t}
    for m in (by_col, by_row):
        m.drop(spark)
        assert not spark.catalog.tableExists(m.table)
    with pytest.raises(ValueError):
        stored.store(a, "k")
    with pytest.raises(ValueError):
        stored.stored_mat_vec(by_row, vector[60])


def test_a_stored_matrix_is_not_shuffled(spark):
    _, a = random_matrix(spark, 40, 60, 500, seed=7)
    v = sparse.SparseVec(spark.createDataFrame([(i, 1.0) for i in range(60)], "i long, value double"), 60)
    matrix = stored.store(a, "j")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored._terms(matrix, v)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # of the two sides of the join only the vector is exchanged
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    matrix.drop(spark)


def test_exact_products_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    entries = [(rng.randrange(20), rng.randrange(300), rng.gauss(0, 1) * 10.0 ** rng.randint(-9, 9)) for _ in range(8_000)]
    values = [(j, rng.gauss(0, 1)) for j in range(300)]
    seen = []
    for parts in (1, 5, 13):
        a = sparse.SparseMat(spark.createDataFrame(entries, "i long, j long, value double").repartition(parts), 20, 300)
        v = sparse.SparseVec(spark.createDataFrame(values, "i long, value double").repartition(parts + 1), 300)
        once = sorted(map(tuple, sparse.mat_vec(a, v, exact=True).df.collect()))
        turned = sorted(map(tuple, sparse.vec_mat(v, sparse.mat_transpose(a), exact=True).df.collect()))
        dot = sparse.vec_dot(v, v, exact=True).first()["value"]
        cells = sorted(map(tuple, sparse.mat_mul(a, sparse.mat_transpose(a), exact=True).df.collect()))
        seen.append((once, turned, dot, cells))
    assert seen[0] == seen[1] == seen[2] and seen[0][0] == seen[0][1]
    assert sparse.vec_dot(sparse.SparseVec(v.df.limit(0), 300), v, exact=True).first()["value"] == 0.0


def test_exact_walk_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    vertices = [(i, rng.random(), rng.choice([0, 0, 1, -1])) for i in range(120)]
    edges = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)}
    seen = []
    for parts in (1, 4, 9):
        net = make(spark, vertices, sorted(edges))
        net = type(net)(net.vertices.repartition(parts), net.edges.repartition(parts + 1))
        seen.append(sorted(map(tuple, walk_rank(net, steps=4, exact=True, links_per_partition=50 * parts).collect())))
    assert seen[0] == seen[1] == seen[2]
    plain = dict(map(tuple, walk_rank(net, steps=4).collect()))
    assert all(plain[i] == pytest.approx(r, abs=1e-12) for i, r in seen[0])


@pytest.mark.parametrize("top_rows", [2, 1_000])
def test_nulls_are_refused_whatever_k_is(spark, top_rows):
    for odd in (None, float("nan")):
        df = spark.createDataFrame([(float(i), i) for i in range(40)] + [(odd, 99)], "x double, id long")
        for k in (1, 5, 20, 41):
            with pytest.raises(ValueError):
                first_k(df, k, "x", "id", top_rows=top_rows)
