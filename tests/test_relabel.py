from collections import Counter

from networks import make, random_network

from contactgraph.operators.relabel import prune_edges, relabel
from contactgraph.schema import check_network


def rows(net):
    return {r["id"]: (r["score"], r["health_status"]) for r in net.vertices.collect()}


def test_relabel_moves_the_quota(spark):
    vertices, edges = random_network(21, n=60, m=90)
    net = make(spark, vertices, edges)
    status = {i: h for i, _, h in vertices}
    scores = {i: (i * 37 % 101) / 101 for i, _, h in vertices if h != -1}
    table = spark.createDataFrame(list(scores.items()), "id long, score double")
    new = relabel(net, table, 7, 4, seed=1)
    got = rows(new)
    assert got.keys() == status.keys()
    best = sorted((i for i in status if status[i] == 0), key=lambda i: (-scores[i], i))[:7]
    assert {i for i in got if status[i] == 0 and got[i][1] == 1} == set(best)
    gone = {i for i in got if status[i] == 1 and got[i][1] == -1}
    assert len(gone) == 4
    for i, (score, h) in got.items():
        if i in best:
            assert (score, h) == (1.0, 1)
        elif i in gone:
            assert (score, h) == (0.0, -1)
        elif status[i] == -1:
            assert h == -1
        else:
            assert (score, h) == (scores[i], status[i])
    kept = sorted(tuple(r) for r in new.edges.collect())
    assert kept == [e for e in edges if not set(e) & gone]
    assert set(check_network(new).first()) == {0}


def test_relabel_ties_go_to_the_lower_id_and_noise_is_ignored(spark):
    net = make(spark, [(1, 0.1, 0), (2, 0.1, 0), (3, 0.1, 0)], [])
    noisy = spark.createDataFrame(
        [(1, 0.3), (2, 0.3 + 1e-16), (3, 0.3 + 5e-15)], "id long, score double"
    )
    assert [h for _, (_, h) in sorted(rows(relabel(net, noisy, 1, 0, seed=1)).items())] == [1, 0, 0]


def test_quota_above_the_pool_takes_everyone(spark):
    vertices, edges = random_network(22, n=20, m=20)
    net = make(spark, vertices, edges)
    new = rows(relabel(net, net.vertices.select("id", "score"), 100, 100, seed=1))
    before = Counter(h for _, _, h in vertices)
    after = Counter(h for _, h in new.values())
    assert after == {1: before[0], -1: before[-1] + before[1]}
    same = rows(relabel(net, net.vertices.select("id", "score"), 0, 0, seed=1))
    assert same == {i: (s, h) for i, s, h in vertices}


def test_prune_removes_every_edge_of_a_hub(spark):
    net = make(spark, [(i, 0.0, 0) for i in range(6)], [(0, 1), (0, 2), (0, 3), (2, 3), (4, 5)])
    gone = spark.createDataFrame([(0,), (5,)], "id long")
    assert [tuple(r) for r in prune_edges(net.edges, gone).collect()] == [(2, 3)]
