import math
import random

import pytest
from pyspark.sql import functions as F

from contactgraph.functions.hashing import portable_uniform
from contactgraph.functions.ordering import (
    dense_index,
    first_k,
    last_of_first,
    sample_k,
    with_next,
)


def rows(spark, seed=1, n=500):
    rng = random.Random(seed)
    data = [(k * 7 - 900, rng.choice([0.0, 0.0, -1.5, rng.random(), 1e-9])) for k in range(n)]
    return spark.createDataFrame(data, "id long, x double"), sorted((x, i) for i, x in data)


@pytest.mark.parametrize("k", [1, 37, 250, 251, 499, 500, 900])
def test_selection_by_counts_equals_a_sort(spark, k):
    df, ordered = rows(spark)
    got = last_of_first(df, k, "x", "id", top_rows=5)
    assert got == ordered[min(k, 500) - 1]


def test_selection_on_wide_integers(spark):
    ids = [-(2**63), -5, 0, 3, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for k, want in enumerate(ids, start=1):
        assert last_of_first(df, k, "id", top_rows=0) == (want,)


INFINITE = [math.inf] * 3 + [-math.inf] * 3 + [1e308, -1e308, 5e-324, 0.0, -0.0]


@pytest.mark.parametrize(
    "values",
    [INFINITE + [float(k) for k in range(40)], [7.0] * 50, [1.0] * 49 + [2.0], [float(k) for k in range(9)] + [9.0] * 60],
)
def test_selection_on_any_ordered_key(spark, values):
    data = list(enumerate(values))
    df = spark.createDataFrame(data, "id long, x double")
    ordered = sorted((x, i) for i, x in data)
    for k in (1, 5, 9, len(values) // 2, len(values)):
        assert last_of_first(df, k, "x", "id", top_rows=2) == ordered[k - 1]


@pytest.mark.parametrize("odd", [None, math.nan])
def test_keys_without_order_are_refused(spark, odd):
    df = spark.createDataFrame([(k, float(k)) for k in range(20)] + [(20, odd)], "id long, x double")
    with pytest.raises(ValueError):
        last_of_first(df, 10, "x", "id", top_rows=2)


@pytest.mark.parametrize("n", [0, 1, 2, 57, 3000])
def test_next_row(spark, n):
    data = [(k % 7, k, f"r{k}" if k % 5 else None) for k in range(n)]
    df = spark.createDataFrame(data, "a long, b long, c string").repartition(6)
    found = {(r["a"], r["b"]): (r["next_a"], r["next_c"]) for r in with_next(df, ["a", "b"], ["a", "c"]).collect()}
    order = sorted(data)
    assert found == {x[:2]: (y[0], y[2]) for x, y in zip(order, order[1:])}


def test_next_row_shuffles_once(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 10).alias("a"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    plan = df.repartitionByRange("a", "id").sortWithinPartitions("a", "id")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    after = with_next(df, ["a", "id"], ["id"])
    text = after._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in text and "Exchange range" not in text and before is not None


def test_first_k(spark):
    df, ordered = rows(spark)
    for k in (0, 1, 260, 600):
        got = sorted((r["x"], r["id"]) for r in first_k(df, k, "x", "id").collect())
        assert got == ordered[:k]
    with pytest.raises(ValueError):
        first_k(df, -1, "id")
    assert first_k(df.limit(0), 5, "x", "id").count() == 0
    assert last_of_first(df.limit(0), 50, "x", "id", top_rows=5) is None


def test_sample_is_a_function_of_seed_and_key(spark):
    df, _ = rows(spark)
    picks = [
        sorted(r["id"] for r in sample_k(df.repartition(p), 40, seed).collect())
        for p, seed in ((1, 1), (7, 1), (7, 2))
    ]
    assert picks[0] == picks[1] != picks[2]
    assert [len(set(p)) for p in picks] == [40, 40, 40]


def test_uniform_is_even(spark):
    u = spark.range(20_000).select(portable_uniform(3, F.col("id")).alias("u"))
    low, high, mean, below = u.agg(
        F.min("u"), F.max("u"), F.avg("u"), F.count_if(F.col("u") < 0.25)
    ).first()
    assert 0 <= low and high < 1
    assert abs(mean - 0.5) < 4 * 0.2887 / 20_000**0.5
    assert abs(below - 5000) < 4 * (20_000 * 0.25 * 0.75) ** 0.5


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_index(spark, partitions):
    df, ordered = rows(spark)
    got = dense_index(df.repartition(partitions), "x", "id").collect()
    assert sorted((r["idx"], r["x"], r["id"]) for r in got) == [
        (n, x, i) for n, (x, i) in enumerate(ordered, start=1)
    ]
    assert dense_index(df.limit(0), "id").count() == 0
