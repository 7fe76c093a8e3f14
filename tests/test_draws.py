"""Numbers of given laws, chances of links, and exactly m links."""

import numpy as np
import pytest
from networks import make, random_network
from pyspark.sql import functions as F

from contactgraph.functions.draws import beta_draw
from contactgraph.functions.ordering import sum_before
from contactgraph.operators import links

N = 20_000


def drawn(spark, a, b, seed=1, partitions=4):
    rows = spark.range(0, N, 1, partitions).select("id", beta_draw(a, b, seed, "id").alias("p"))
    return np.array([r["p"] for r in rows.orderBy("id").collect()])


def distance(a, b):
    """Largest distance between two empirical distribution functions."""
    places = np.sort(np.concatenate([a, b]))
    return np.abs(
        np.searchsorted(np.sort(a), places, "right") / len(a) - np.searchsorted(np.sort(b), places, "right") / len(b)
    ).max()


@pytest.mark.parametrize("a, b", [(1.0, 1.0), (3.0, 15_000.0), (0.3, 0.6), (31.0, 145.0), (0.01, 2.0)])
def test_beta_moments_and_distribution(spark, a, b):
    p = drawn(spark, a, b)
    assert ((p >= 0) & (p <= 1)).all()
    mean, variance = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    assert abs(p.mean() - mean) < 5 * np.sqrt(variance / N)
    assert abs(p.var() / variance - 1) < 0.2
    # 1.95 is passed by one in a thousand pairs of samples of the same law
    other = np.random.default_rng(5).beta(a, b, N)
    assert distance(p, other) < 1.95 * np.sqrt(2 / N)


def test_beta_is_a_function_of_the_row(spark):
    assert (drawn(spark, 2.0, 5.0) == drawn(spark, 2.0, 5.0, partitions=7)).all()
    assert (drawn(spark, 2.0, 5.0) != drawn(spark, 2.0, 5.0, seed=2)).mean() > 0.99


@pytest.mark.parametrize("a, b", [(0.0, 1.0), (1.0, -1.0), (float("nan"), 1.0), (1.0, float("inf"))])
def test_beta_refuses_other_shapes(a, b):
    with pytest.raises(ValueError):
        beta_draw(a, b, 1, "id")


def test_odd_column_names(spark):
    rows = spark.range(3).select(F.col("id").alias("x`'y"))
    assert rows.select(beta_draw(1.0, 2.0, "it's", "x`'y").alias("p")).count() == 3


def test_chances_have_the_law_of_a_chance_per_pair(spark):
    """Against drawing a chance for every pair and then the link."""
    pairs = spark.range(N).select(F.col("id").alias("src"), (F.col("id") + N).alias("dst"))
    got = [r["chance"] for r in links.link_chances(pairs, 2.0, 3.0, 4.0, 9).collect()]
    rng = np.random.default_rng(3)
    chances = rng.beta(2.0, 7.0, 10 * N)
    linked = chances[rng.random(10 * N) < chances]
    assert distance(np.array(got), linked) < 1.95 * np.sqrt(1 / N + 1 / len(linked))


def test_sums_of_the_rows_before(spark):
    rows = [(k % 7, k, None if k % 5 == 0 else k * k) for k in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(9)
    got = {(r["a"], r["b"]): r["before"] for r in sum_before(df, ["a", "b"], "v").collect()}
    total, want = 0, {}
    for a, b, v in sorted(rows, key=lambda r: r[:2]):
        want[a, b] = total
        total += v or 0
    assert got == want
    assert sum_before(df.limit(0), ["a", "b"], "v").count() == 0


def missing(vertices, edges):
    ids, there = sorted(v[0] for v in vertices), set(edges)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (a, b) not in there}


@pytest.mark.parametrize("share", [0.02, 0.45, 0.55, 0.97, 1.0, 2.0])
def test_exactly_m_links(spark, share):
    vertices, edges = random_network(4)
    pairs = missing(vertices, edges)
    m = int(share * len(pairs))
    got = [tuple(r) for r in links.draw_links(make(spark, vertices, edges), m, 3).collect()]
    assert len(got) == len(set(got)) == min(m, len(pairs))
    assert set(got) <= pairs
    again = links.draw_links(make(spark, vertices, edges, partitions=6), m, 3).collect()
    assert {tuple(r) for r in again} == set(got)


def test_no_links(spark):
    vertices, edges = random_network(4, n=5, m=2)
    net = make(spark, vertices, edges)
    assert links.draw_links(net, 0, 3).count() == 0
    assert links.draw_links(make(spark, vertices, []), 3, 1, F.lit(False)).count() == 0
    complete = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    assert links.draw_links(make(spark, [(i, 0.5, 0) for i in range(4)], complete), 3, 1).count() == 0
    with pytest.raises(ValueError):
        links.draw_links(net, -1, 3)


def test_only_eligible_vertices_get_links(spark):
    vertices, edges = random_network(6)
    net = make(spark, vertices, edges)
    active = {v[0] for v in vertices if v[2] != -1}
    got = links.draw_links(net, 100, 3, F.col("health_status") != -1).collect()
    assert len(got) == 100
    assert all(r["src"] in active and r["dst"] in active for r in got)


@pytest.mark.parametrize("m", [3, 8])
def test_every_missing_pair_is_equally_likely(spark, m):
    """Six vertices and four edges: 11 missing pairs, each in m of 11 draws."""
    net = make(spark, [(i, 0.5, 0) for i in range(6)], [(0, 1), (0, 3), (2, 3), (4, 5)])
    ranges, _ = links.missing_ranges(net)
    assert ranges.select(F.sum(F.expr("last - first + 1"))).first()[0] == 11
    counts, seeds = np.zeros(11), 4_000
    k = m if m <= 5 else 11 - m
    # the numbers are the only chance in it, so their law is the links' law; all seeds in one job
    ids = spark.range(60).crossJoin(spark.range(seeds).select(F.col("id").alias("seed")))
    number = links._numbers_below(11, "all", "both")
    rows = ids.withColumn("both", F.concat_ws("|", "seed", "id")).withColumn("pos", number)
    firsts = rows.groupBy("seed", "pos").agg(F.min("id").alias("id"))
    by_seed = {}
    for r in firsts.collect():
        by_seed.setdefault(r["seed"], []).append((r["id"], r["pos"]))
    for found in by_seed.values():
        for _, pos in sorted(found)[:k]:
            counts[pos] += 1
    expected = seeds * k / 11
    # without replacement the statistic is smaller by (11 - k) / 10; 29.6 is passed once in a thousand
    assert ((counts - expected) ** 2 / expected).sum() / ((11 - k) / 10) < 29.6


def test_numbers_beyond_one_uniform(spark):
    total = 3 * 2**60
    rows = spark.range(N).select(links._numbers_below(total, 7, "id").alias("pos"))
    pos = np.array([r["pos"] for r in rows.collect()], dtype=object)
    inside = np.array([int(p) for p in pos if p < total])
    assert len(inside) > 0.99 * N
    assert abs(np.mean(inside / total) - 0.5) < 0.02
    assert abs(np.mean(inside % 2) - 0.5) < 0.02


def test_numbers_that_repeat_are_drawn_again(spark):
    got = sorted(r["pos"] for r in links._distinct_numbers(spark, 50, 100, 11).collect())
    assert len(got) == len(set(got)) == 50
    assert got[0] >= 0 and got[-1] < 100
