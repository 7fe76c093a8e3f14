import numpy as np
import pytest
from networks import low_skew_limits
from pyspark.sql import functions as F

from contactgraph.operators import sparse as sp


def vec(spark, values):
    data = [(i, float(x)) for i, x in enumerate(values) if x]
    return sp.SparseVec(spark.createDataFrame(data, "i long, value double"), len(values))


def mat(spark, values):
    data = [(int(i), int(j), float(values[i, j])) for i, j in zip(*np.nonzero(values))]
    df = spark.createDataFrame(data, "i long, j long, value double")
    return sp.SparseMat(df, *values.shape)


def dense(x):
    out = np.zeros(x.size)
    for row in x.df.collect():
        out[tuple(row)[:-1]] += row["value"]
    return out


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(4)

    def some(*shape):
        return np.round(rng.normal(size=shape), 2) * (rng.random(shape) < 0.5)

    return some(6), some(6), some(5, 6), some(6, 4), some(5, 6)


def test_products(spark, numbers):
    u, v, a, b, c = numbers
    su, sv, sa, sb, sc = vec(spark, u), vec(spark, v), mat(spark, a), mat(spark, b), mat(spark, c)
    assert sp.vec_dot(su, sv).first()[0] == pytest.approx(u @ v)
    assert np.allclose(dense(sp.vec_add(su, sv)), u + v)
    assert np.allclose(dense(sp.vec_sub(su, sv)), u - v)
    assert np.allclose(dense(sp.vec_hadamard(su, sv)), u * v)
    assert np.allclose(dense(sp.vec_outer(su, sv)), np.outer(u, v))
    assert np.allclose(dense(sp.vec_outer(su, sv, side=2)), np.outer(u, v))
    assert np.allclose(dense(sp.mat_vec(sa, su)), a @ u)
    assert np.allclose(dense(sp.vec_mat(su, sb)), u @ b)
    assert np.allclose(dense(sp.mat_mul(sa, sb)), a @ b)
    assert np.allclose(dense(sp.mat_mul(sa, sb, side=1)), a @ b)
    assert np.allclose(dense(sp.mat_hadamard(sa, sc)), a * c)
    assert np.allclose(dense(sp.mat_transpose(sa)), a.T)
    assert np.allclose(dense(sp.mat_diag(su)), np.diag(u))
    assert np.allclose(dense(sp.mat_scale_cols(sa, su)), a @ np.diag(u))
    assert np.allclose(dense(sp.mat_scale_rows(su, sb)), np.diag(u) @ b)
    assert np.allclose(dense(sp.mat_apply(sa, lambda x: x * 3)), a * 3)
    assert np.allclose(dense(sp.vec_apply(su, F.abs)), np.abs(u))


def test_small_examples(spark):
    v = vec(spark, [1, 2, 3])
    gap = vec(spark, [1, 0, 3])
    assert sp.vec_dot(v, gap).first()[0] == 10.0
    assert sp.vec_dot(vec(spark, [1, 0]), vec(spark, [0, 5])).first()[0] == 0.0
    m = mat(spark, np.array([[0, 1.2, 4], [2.1, 0, 0], [0, 0, 0]]))
    assert np.allclose(dense(sp.mat_vec(m, v)), [14.4, 2.1, 0])
    assert sp.mat_vec(m, v).df.count() == 2  # zeros are not stored
    assert dense(sp.vec_repeat(spark, 0.5, 4)).tolist() == [0.5] * 4
    ids = spark.createDataFrame([(3,), (1,)], "id long")
    assert dense(sp.vec_constant_on(ids, 2, 5)).tolist() == [0, 2, 0, 2, 0]
    assert sp.vec_sub(v, gap).df.filter("value = 0").count() == 2  # sums keep them


def test_rows_come_in_bounded_pieces(spark):
    a = np.arange(1.0, 23).reshape(2, 11)
    pieces = sp.matrix_rows(mat(spark, a), width=4).orderBy("i", "block").collect()
    assert [(r["i"], r["block"], [c["j"] for c in r["cells"]]) for r in pieces] == [
        (i, b, list(range(4 * b, min(4 * b + 4, 11)))) for i in range(2) for b in range(3)
    ]


def test_sizes_and_types_are_checked(spark, numbers):
    u, v, a, b, _ = numbers
    su, sa, sb = vec(spark, u), mat(spark, a), mat(spark, b)
    short = vec(spark, u[:3])
    for call in (
        lambda: sp.vec_dot(su, short),
        lambda: sp.vec_add(su, short),
        lambda: sp.mat_vec(sa, short),
        lambda: sp.vec_mat(short, sb),
        lambda: sp.mat_mul(sb, sa),
        lambda: sp.mat_hadamard(sa, sb),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(TypeError):
        sp.mat_mul(sa, su)
    twice = sp.SparseVec(su.df.unionByName(su.df), su.size)
    with pytest.raises(ValueError):
        sp.validate(twice)
    sp.validate(sp.coalesce(twice))
    assert np.allclose(dense(sp.coalesce(twice)), 2 * u)
    with pytest.raises(ValueError):
        sp.validate(sp.SparseVec(su.df, 2))


@pytest.mark.parametrize("listed", [100_000, 1])
def test_product_over_hot_indices(spark, monkeypatch, listed):
    """Two indices hold most entries on both sides; both ways of splitting."""
    monkeypatch.setattr(sp, "_LISTED", listed)
    rng = np.random.default_rng(5)
    a, b = np.zeros((40, 12)), np.zeros((12, 30))
    a[:, 3], a[:, 8], b[3, :], b[8, :] = (rng.random(n) for n in (40, 40, 30, 30))
    a[:5, 1], b[1, :4] = 2.0, 3.0
    assert np.allclose(dense(sp.mat_mul(mat(spark, a), mat(spark, b), side=7)), a @ b)


def test_outer_product_follows_stored_entries(spark):
    """A huge declared size costs nothing: one entry meets many without copies of these."""
    u = sp.vector_from_df(spark.range(1).select("id", F.lit(2.0).alias("v")), 10**12, i="id", value="v")
    v = sp.vector_from_df(spark.range(2_000).select("id", F.lit(3.0).alias("v")), 10**12, i="id", value="v")
    product = sp.vec_outer(u, v)
    assert product.size == (10**12, 10**12)
    assert product.df.agg(F.count("*"), F.sum("value")).first() == (2_000, 12_000.0)
    with low_skew_limits(spark):
        cut = sp.vec_outer(v, v, side=700).df
        assert cut.count() == 4_000_000
        assert sum(_rows_made(cut.limit(1_000), "Generate")) <= 2 * 3 * 2_000


def _rows_made(df, node):
    """Rows that the nodes of one kind put out in the run of ``df``."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while todo:
        here = todo.pop()
        if here.nodeName() == node:
            found.append(here.metrics().apply("numOutputRows").value())
        if "QueryStage" in here.nodeName():
            todo.append(here.plan())
        children = here.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_hot_index_is_split(spark):
    """A third of all entries share one index; the join on it is split."""
    n = 30_000
    with low_skew_limits(spark):
        j = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
        cells = spark.range(n).select(
            (F.col("id") % 1000).alias("i"), j.alias("j"), F.lit(1.0).alias("value")
        )
        a = sp.SparseMat(cells.repartition(8), 1000, n)
        stored = sp.vec_repeat(spark, 1.0, n)
        summed = sp.coalesce(stored)  # already partitioned by the index
        for v in (stored, summed):
            product = sp.mat_vec(a, v).df
            rows = product.collect()
            assert len(rows) == 1000 and sum(r["value"] for r in rows) == n
            assert "skew=true" in product._jdf.queryExecution().executedPlan().toString()
