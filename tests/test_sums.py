"""Sums in any order give the same bits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contactgraph.functions.sums import exact_sum


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, value double")


def sums(df):
    return {r["k"]: r["value"] for r in exact_sum(df, "k").collect()}


def test_sums_are_exact(spark):
    rng = random.Random(0)
    groups = {
        0: [0.1] * 1_000,
        1: [rng.uniform(-1, 1) for _ in range(5_000)],
        2: [rng.uniform(-1, 1) * 2.0 ** rng.randint(-200, 200) for _ in range(3_000)],
        3: [1e16, 1.0, -1e16, 1e-16, -1.0],
        4: [5e-324, 5e-324, -5e-324, 2.2e-308],
        5: [1.7e308, -1.7e308, 1e290, 3.0],
        6: [2.0 ** (32 * k) * s for k in range(-30, 31) for s in (1, -0.5, 1 - 2**-53)],
        7: [0.0, -0.0],
        8: [2.0**-32, 2.0**32, 2.0**64, 1.0, math.nextafter(2.0**32, 0)],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    found = sums(table(spark, rows))
    assert found == {k: math.fsum(xs) for k, xs in groups.items()}


def test_partitions_and_order_do_not_matter(spark):
    rng = random.Random(1)
    rows = [(i % 3, rng.gauss(0, 1) * 10.0 ** rng.randint(-12, 12)) for i in range(20_000)]
    df = table(spark, rows)
    ways = [df.repartition(1), df.repartition(7, "value"), df.repartition(5).sortWithinPartitions("value"), df.orderBy(F.desc("value"))]
    found = [sums(way) for way in ways]
    assert all(f == found[0] for f in found)
    assert found[0] == {k: math.fsum(x for j, x in rows if j == k) for k in range(3)}


def test_nulls_and_what_is_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, None), (1, None), (1, 2.5), (2, inf), (2, 1.0), (3, inf), (3, -inf), (4, nan), (4, 1.0), (5, -inf), (5, 1e300)]
    found = sums(table(spark, rows))
    assert found[0] is None and found[1] == 2.5 and found[2] == inf and found[5] == -inf
    assert math.isnan(found[3]) and math.isnan(found[4])
    assert sums(table(spark, [])) == {}
    assert exact_sum(table(spark, [(1, 0.1), (2, 0.2)]).select("value")).first()["value"] == pytest.approx(0.3)
    assert exact_sum(table(spark, []).select("value")).collect()[0]["value"] is None
