from contextlib import contextmanager

import pytest
from networks import brute_walk, low_skew_limits, make, plan_lines, random_network
from pyspark.sql import functions as F

from contactgraph.operators import graph
from contactgraph.operators.relabel import prune_edges
from contactgraph.schema import Network
from contactgraph.session import cut_lineage, partition_count, spread


@contextmanager
def broadcasts_off(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# The worked example of five vertices that the golden numbers belong to.
WALK5 = (
    [(1, 0.9, 0), (2, 0.9, 0), (3, 0.2, 0), (4, 0.4, 0), (5, 0.2, 0)],
    [(1, 2), (1, 3), (2, 3), (3, 4)],
)


def as_dict(df):
    return {row[0]: row[1] for row in df.collect()}


@pytest.mark.parametrize(
    "steps, tolerance, rank, score",
    [
        (
            3,
            2e-6,
            [0.094475, 0.094475, 0.536261, 0.268472, 0.006317],
            [0.909447, 0.909447, 0.629009, 0.561083, 0.205054],
        ),
        (
            20,
            1e-5,
            [0.091605, 0.091605, 0.538241, 0.278548, 0.0],
            [0.909161, 0.909161, 0.630593, 0.567129, 0.2],
        ),
    ],
)
def test_worked_example(spark, steps, tolerance, rank, score):
    net = make(spark, *WALK5)
    r = as_dict(graph.walk_rank(net, -2.0, steps))
    assert [r[i] for i in range(1, 6)] == pytest.approx(rank, abs=tolerance)
    s = as_dict(graph.rescore(net, -2.0, steps))
    assert [s[i] for i in range(1, 6)] == pytest.approx(score, abs=tolerance)


@pytest.mark.parametrize("seed, scope", [(1, "both"), (2, "both"), (3, "either"), (4, "either")])
def test_walk_equals_dense_formula(spark, seed, scope):
    vertices, edges = random_network(seed, m=30)
    got = as_dict(graph.walk_rank(make(spark, vertices, edges), -2.0, 4, scope, cut_every=2))
    want = brute_walk(vertices, edges, -2.0, 4, scope)
    assert got == pytest.approx(want, abs=1e-12)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-12)


def test_hubs_give_the_same_walk(spark):
    vertices, edges = random_network(7, n=60, m=30)
    hub = vertices[0][0]
    vertices[0] = (hub, 0.5, 0)
    edges = sorted(set(edges) | {(hub, i) for i, _, _ in vertices[1:45]})
    net = make(spark, vertices, edges)
    want = brute_walk(vertices, edges, -2.0, 4)
    assert as_dict(graph.walk_rank(net, -2.0, 4, hub_links=5)) == pytest.approx(want, abs=1e-12)
    assert as_dict(graph.walk_rank(net, -2.0, 4)) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_walk_does_not_depend_on_partitions(spark, partitions):
    vertices, edges = random_network(5)
    got = as_dict(graph.walk_rank(make(spark, vertices, edges, partitions), -2.0, 3))
    assert got == pytest.approx(brute_walk(vertices, edges, -2.0, 3), abs=1e-12)


def test_walk_corner_cases(spark):
    vertices, edges = random_network(6, n=12, m=8)
    net = make(spark, vertices, edges)
    n = sum(h != -1 for _, _, h in vertices)
    assert set(as_dict(graph.walk_rank(net, -2.0, 0)).values()) == {1 / n}
    lonely = make(spark, vertices, [])
    want = brute_walk(vertices, [], -2.0, 3)
    assert as_dict(graph.walk_rank(lonely, -2.0, 3)) == pytest.approx(want, abs=1e-12)
    nobody = make(spark, [(1, 0.0, -1), (2, 0.0, -1)], [(1, 2)])
    assert graph.walk_rank(nobody, -2.0, 3).count() == 0
    with pytest.raises(ValueError):
        graph.walk_rank(net, steps=-1)
    with pytest.raises(ValueError):
        graph.walk_rank(net, scope="neither")


def test_equal_scores_tend_to_degree(spark):
    vertices = [(i, 0.3, 0) for i in range(4)]
    edges = [(0, 1), (1, 2), (2, 3), (0, 2)]
    got = as_dict(graph.walk_rank(make(spark, vertices, edges), -2.0, 20))
    closed = [3, 3, 4, 2]
    assert [got[i] for i in range(4)] == pytest.approx([d / sum(closed) for d in closed], abs=1e-6)


def test_transition_rows_sum_to_one(spark):
    vertices, edges = random_network(8)
    net = make(spark, vertices, edges)
    for scope in ("both", "either"):
        whole = graph.transition_matrix(net, -2.0, scope, isolated_rows=True)
        rows = whole.groupBy("i").agg(F.sum("value").alias("t")).collect()
        assert len(rows) == graph.active_vertices(net.vertices).count()
        assert all(abs(row["t"] - 1) < 1e-12 for row in rows)
        thin = graph.transition_matrix(net, -2.0, scope)
        isolated = {r["id"] for r in graph.isolated_vertices(net, scope).collect()}
        assert isolated and not isolated & {r["i"] for r in thin.select("i").collect()}
        shares = {r["id"]: r["share"] for r in graph.isolated_shares(net, -2.0).collect()}
        first = {r["j"]: r["value"] for r in whole.filter(F.col("i") == min(isolated)).collect()}
        assert first == pytest.approx(shares)


def test_transition_matrix_shuffles_little(spark):
    net = make(spark, *random_network(8, n=60, m=90))
    with broadcasts_off(spark):
        rows = graph.transition_matrix(net, -2.0)
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert 0 < final.count("Exchange hashpartitioning") <= 6


def test_partitions_follow_the_links(spark):
    vertices, edges = random_network(9, n=200, m=400)
    net = make(spark, vertices, edges)
    few = as_dict(graph.walk_rank(net, -2.0, 2))
    many = graph.walk_rank(net, -2.0, 2, links_per_partition=20)
    assert as_dict(many) == pytest.approx(few)
    assert partition_count(spark, 10**9) == 500 and partition_count(spark, 1) == 4
    assert spread(spark.range(10), "id", rows=10**8).rdd.getNumPartitions() == 50


def test_closed_adjacency(spark):
    net = make(spark, [(1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 1), (4, 0.0, -1)], [(1, 2), (3, 4)])
    thin = {(r["i"], r["j"]) for r in graph.closed_adjacency(net).collect()}
    assert thin == {(1, 2), (2, 1), (1, 1), (2, 2), (3, 3)}
    full = {(r["i"], r["j"]) for r in graph.closed_adjacency(net, materialise=True).collect()}
    assert full - thin == {(3, 1), (3, 2)}
    either = graph.closed_adjacency(net, "either", materialise=True)
    assert {(r["i"], r["j"]) for r in either.collect()} == thin


def test_scores_and_vectors(spark):
    net = make(spark, *WALK5)
    kept, v = graph.score_vector(net.vertices, F.col("id") > 2)
    assert v.size == kept.count() == 3
    assert as_dict(graph.vector_to_scores(v)) == {3: 0.2, 4: 0.4, 5: 0.2}


@pytest.mark.parametrize("hub_links", [10**6, 8])
def test_walk_needs_one_shuffle_per_step(spark, hub_links):
    """Links and vertices stay put; only partial sums move, hubs or not."""
    vertices, edges = random_network(9, n=200, m=400)
    net = make(spark, vertices, edges)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = []

        def hold(df):
            held.append(df.persist())
            return held[-1]

        links = graph.both_directions(cut_lineage(net.edges))
        base = cut_lineage(graph._walk_vertices(net, links, -2.0, "both"))
        base = hold(base.repartition(4, "id").sortWithinPartitions("id"))
        base.count()
        degrees = base.filter("degree is not null").select("id", "degree")
        near = graph._Neighbours(links, degrees, 2 * len(edges), 4, hub_links, hold)
        assert (near.hubs is None) == (hub_links > 1000)
        x = base.select("id", F.col("weight").alias("x"))
        moved = base.join(near.sums(x), "id").select("id", "total")
        shuffles = [line for line in plan_lines(moved) if "ENSURE_REQUIREMENTS" in line]
        assert len(shuffles) == 1 and "hashpartitioning(j" in shuffles[0]
        for df in held:
            df.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_network_with_unordered_duplicates(spark):
    vertices = [(i, 0.1 * i, 0) for i in range(4)]
    net = make(spark, vertices, [(1, 0), (0, 1), (2, 2), (2, 3), (2, 3)])
    assert sorted(tuple(r) for r in net.edges.collect()) == [(0, 1), (2, 3)]
    assert isinstance(net, Network)


def test_hot_vertex_is_split(spark):
    """A third of the edges share a vertex; the joins with vertices split it."""
    n = 30_000
    with low_skew_limits(spark):
        vertices = spark.range(n).select(
            "id", F.lit(0.5).alias("score"), F.lit(0).alias("health_status")
        )
        src = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - 1)
        edges = spark.range(1, n).select(src.alias("src"), F.col("id").alias("dst"))
        net = Network(vertices, edges.repartition(8))
        status = F.max("health_status").alias("health_status")
        grouped = Network(vertices.groupBy("id").agg(status), net.edges)
        for df in (
            graph.active_edges(net),
            graph.active_edges(grouped),
            prune_edges(net.edges, spark.range(n, n + 5), canonical=True),
        ):
            assert len(df.collect()) == n - 1
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
