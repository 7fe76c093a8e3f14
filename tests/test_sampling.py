import math
from collections import Counter
from itertools import combinations

import pytest
from networks import make, random_network
from pyspark.sql import functions as F

from contactgraph.operators import links
from contactgraph.operators.links import missing_pairs, propose_links, skip_levels
from contactgraph.operators.sampling import disjoint_pairs, initial_network, label_sample
from contactgraph.schema import Network, check_network


def pairs(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_labels(spark):
    got = label_sample(spark.range(200), 30, 20, seed=5).collect()
    assert Counter(r["health_status"] for r in got) == {1: 30, -1: 20, 0: 150}
    assert all(r["score"] == (1.0 if r["health_status"] == 1 else 0.0) for r in got)
    other = label_sample(spark.range(200).repartition(5), 30, 20, seed=5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, other))
    everyone = label_sample(spark.range(5), 3, 9, seed=5).collect()
    assert Counter(r["health_status"] for r in everyone) == {1: 3, -1: 2}
    assert all(r["health_status"] == 0 for r in label_sample(spark.range(5), 0, 0, 5).collect())


@pytest.mark.parametrize("n, m, size", [(50, 12, 12), (50, 30, 20), (50, 60, 0)])
def test_disjoint_pairs(spark, n, m, size):
    got = pairs(disjoint_pairs(spark.range(n), m, seed=3))
    assert len(got) == size
    ends = Counter(x for pair in got for x in pair)
    assert all(c == 1 for c in ends.values())
    assert all(a < b for a, b in got)


def test_initial_network(spark):
    net = initial_network(spark.range(20), 9, 3, 2, seed=4)
    assert set(check_network(net).first()) == {0}
    assert net.edges.count() == 9
    assert Counter(r["health_status"] for r in net.vertices.collect()) == {1: 3, -1: 2, 0: 15}


def missing(vertices, edges):
    return set(combinations(sorted(i for i, _, _ in vertices), 2)) - set(edges)


def test_missing_ranges_and_pairs(spark, monkeypatch):
    vertices, edges = random_network(11, n=30, m=80)
    hub = min(i for i, _, _ in vertices)
    edges = sorted(set(edges) | {(hub, i) for i, _, _ in vertices if i > hub and i % 3})
    net = make(spark, vertices, edges)
    ranges, ids = links.missing_ranges(net)
    at = {r["idx"]: r["id"] for r in ids.collect()}
    found = ranges.collect()
    assert len(found) <= len(vertices) + len(edges)
    spelt = [(r["src"], at[k]) for r in found for k in range(r["first"], r["last"] + 1)]
    assert len(spelt) == len(set(spelt)) and set(spelt) == missing(vertices, edges)
    monkeypatch.setattr(links, "_PIECE", 4)
    assert pairs(missing_pairs(net)) == missing(vertices, edges)
    some = [v for v in vertices if v[2] == 0]
    assert pairs(missing_pairs(net, F.col("health_status") == 0)) == missing(some, edges)
    assert links.missing_ranges(make(spark, [(1, 0.0, 0)], []))[0].count() == 0


@pytest.mark.parametrize(
    "alpha, beta, sdf, piece", [(30, 75, 70, 1_024), (30, 75, 70, 2), (9, 0.5, 0.5, 1_024), (1, 60, 60, 1_024)]
)
def test_link_rate(spark, monkeypatch, alpha, beta, sdf, piece):
    monkeypatch.setattr(links, "_PIECE", piece)
    vertices, edges = random_network(12, n=220, m=2000)
    possible = missing(vertices, edges)
    net = make(spark, vertices, edges)
    got = pairs(propose_links(net, alpha, beta, sdf, seed=8))
    assert got <= possible
    rate = alpha / (alpha + beta + sdf)
    for inside in (lambda p: True, lambda p: (p[0] + p[1]) % 2 == 0, lambda p: p[0] < 200):
        n = sum(map(inside, possible))
        hits = sum(map(inside, got))
        assert abs(hits - n * rate) < 4 * math.sqrt(n * rate * (1 - rate))


def test_skip_draws_are_even_over_targets_and_independent(spark):
    """Chi-square over target position, and over pairs of neighbouring targets."""
    n, rate = 1500, 0.02
    net = Network(make(spark, [(i, 0.0, 0) for i in range(n)], []).vertices, spark.sql(
        "select cast(0 as bigint) src, cast(0 as bigint) dst where false"
    ))
    got = pairs(propose_links(net, 2, 49, 49, seed=1))
    assert skip_levels(rate) == 6
    both = sum((a, b + 1) in got for a, b in got)
    possible = n * (n - 1) / 2
    assert abs(both - possible * rate**2) < 5 * math.sqrt(possible * rate**2)
    by_place = Counter((b - a - 1) % 64 for a, b in got)
    chi = sum(
        (by_place[k] - rate * t) ** 2 / (rate * t)
        for k in range(64)
        for t in [sum(len(range(a + 1 + k, n, 64)) for a in range(n))]
    )
    assert chi < 63 + 5 * math.sqrt(2 * 63)


def test_skip_is_repeatable_and_rejects_bad_input(spark):
    vertices, edges = random_network(13, n=60, m=50)
    net = make(spark, vertices, edges)
    again = Network(net.vertices.repartition(5), net.edges)
    first = pairs(propose_links(net, 1, 10, 10, seed=2))
    assert first == pairs(propose_links(again, 1, 10, 10, seed=2))
    assert first != pairs(propose_links(net, 1, 10, 10, seed=3))
    for bad in ((0, 1, 1), (1, 0, 0), (1, -2, 1)):
        with pytest.raises(ValueError):
            propose_links(net, *bad, seed=1)
    with pytest.raises(ValueError):
        propose_links(net, 1e300, 1, 1, seed=1)


def test_links_per_source_meet_their_expectation(spark):
    """The number of links of each source is binomial: mean, and spread over sources."""
    n, rate = 900, 0.05
    net = make(spark, [(i, 0.0, 0) for i in range(n)], [(0, 1)])
    got = Counter(a for a, _ in pairs(propose_links(net, 5, 45, 50, seed=6)))
    z = [(got[a] - rate * (n - 1 - a)) / math.sqrt(rate * (1 - rate) * (n - 1 - a)) for a in range(1, n - 200)]
    assert abs(sum(z) / len(z)) < 4 / math.sqrt(len(z))
    assert 0.8 < sum(x * x for x in z) / len(z) < 1.2
