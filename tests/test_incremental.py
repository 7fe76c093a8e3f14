"""Walks after changes and walks to their limit, against full walks."""

import random

import pytest
from networks import brute_walk, make, random_network
from test_graph import WALK5, as_dict

from contactgraph.operators.graph import rescore, walk_limit, walk_rank
from contactgraph.operators.incremental import update_walk, walk_state
from contactgraph.schema import EDGES, VERTICES


def changed_network(seed, n, m, changes, recovered=0.2):
    """A network, changes to it, and the network after them."""
    rng = random.Random(seed)
    vertices, edges = random_network(seed, n=n, m=m, recovered=recovered)
    by_id = {v[0]: v for v in vertices}
    upserts = {}
    for _ in range(changes):
        i = rng.choice([*by_id, max(by_id) + 1 + len(upserts)])
        upserts[i] = (i, rng.random(), rng.choice([0, 1, -1]))
    pool = sorted({*by_id, *upserts})
    removed = rng.sample(edges, changes)
    added = [tuple(sorted(rng.sample(pool, 2))) for _ in range(changes)]
    after_v = sorted((by_id | upserts).values())
    after_e = sorted((set(edges) - set(removed)) | set(added))
    return (vertices, edges), (sorted(upserts.values()), added, removed), (after_v, after_e)


def frames(spark, vertices, added, removed):
    return (
        spark.createDataFrame([(i, float(s), h) for i, s, h in vertices], VERTICES),
        spark.createDataFrame([(b, a) for a, b in added], EDGES),
        spark.createDataFrame(removed, EDGES),
    )


@pytest.mark.parametrize("seed, n, m, changes, recovered", [(1, 40, 60, 4, 0.2), (2, 60, 20, 8, 0.3)])
def test_updates_agree_with_full_walks(spark, seed, n, m, changes, recovered):
    before, delta, after = changed_network(seed, n, m, changes, recovered)
    state = walk_state(make(spark, *before), steps=3)
    assert as_dict(state.rank()) == pytest.approx(brute_walk(*before, -2.0, 3), abs=1e-12)
    state = update_walk(state, *frames(spark, *delta))
    want = brute_walk(*after, -2.0, 3)
    assert as_dict(state.rank()) == pytest.approx(want, abs=1e-9)
    # and once more, from what was kept, back to where it began
    back = [v for v in before[0] if v[0] in {i for i, *_ in delta[0]}]
    gone = [(i, 0.0, -1) for i, *_ in delta[0] if i not in {v[0] for v in before[0]}]
    edges_back = sorted(set(before[1]) - set(after[1])), sorted(set(after[1]) - set(before[1]))
    state = update_walk(state, *frames(spark, back + gone, *edges_back))
    assert as_dict(state.rank()) == pytest.approx(brute_walk(*before, -2.0, 3), abs=1e-9)


def test_only_what_changed_travels(spark):
    """On a long chain a change at one end reaches as many vertices as it has steps."""
    n = 400
    vertices = [(i, 0.3, 0) for i in range(n)]
    edges = [(i, i + 1) for i in range(n - 1)]
    state = walk_state(make(spark, vertices, edges), steps=4)
    state = update_walk(state, removed=spark.createDataFrame([(0, 1)], EDGES))
    assert max(state.touched) <= 8 and len(state.touched) == 5
    want = brute_walk(vertices, edges[1:], -2.0, 4)
    assert as_dict(state.rank()) == pytest.approx(want, abs=1e-9)


def test_small_changes_are_let_go_within_the_bound(spark):
    vertices, edges = random_network(5, n=120, m=150, recovered=0.0)
    state = walk_state(make(spark, vertices, edges), steps=3)
    upsert = [(vertices[0][0], vertices[0][1] + 1e-7, 0)]
    after = [upsert[0], *vertices[1:]]
    want = brute_walk(after, edges, -2.0, 3)
    touched = {}
    for bound in (1e-14, 1e-6):
        new = update_walk(state, frames(spark, upsert, [], [])[0], bound=bound)
        got = as_dict(new.rank())
        assert sum(abs(got[i] - want[i]) for i in want) < max(bound, 1e-12)
        touched[bound] = sum(new.touched)
    assert touched[1e-6] < touched[1e-14]


def test_no_change_and_no_edges(spark):
    vertices, edges = random_network(6)
    state = walk_state(make(spark, vertices, edges), steps=3)
    assert as_dict(update_walk(state).rank()) == pytest.approx(as_dict(state.rank()), abs=1e-15)
    lone = walk_state(make(spark, vertices, []), steps=3)
    assert as_dict(lone.rank()) == pytest.approx(brute_walk(vertices, [], -2.0, 3), abs=1e-12)
    joined = update_walk(lone, added=spark.createDataFrame(edges, EDGES))
    assert as_dict(joined.rank()) == pytest.approx(brute_walk(vertices, edges, -2.0, 3), abs=1e-9)
    with pytest.raises(ValueError):
        walk_state(make(spark, vertices, edges), steps=0)


def test_the_limit_is_where_a_thousand_steps_lead(spark):
    limit = as_dict(walk_limit(make(spark, *WALK5)))
    assert limit == pytest.approx(brute_walk(*WALK5, -2.0, 1_000), abs=1e-9)
    assert as_dict(rescore(make(spark, *WALK5), steps=None)) == pytest.approx(as_dict(rescore(make(spark, *WALK5), steps=60)), abs=1e-9)


@pytest.mark.parametrize("seed, scope, m", [(1, "both", 30), (3, "both", 0), (4, "either", 8)])
def test_limits_of_networks(spark, seed, scope, m):
    vertices, edges = random_network(seed, n=25, m=m)
    limit = as_dict(walk_limit(make(spark, vertices, edges), -2.0, scope))
    assert limit == pytest.approx(brute_walk(vertices, edges, -2.0, 20_000, scope), abs=1e-7)
    assert sum(limit.values()) == pytest.approx(1.0)


def test_limit_of_nothing(spark):
    assert walk_limit(make(spark, [(1, 0.0, -1)], [])).count() == 0
    assert walk_rank(make(spark, [(1, 0.0, -1)], []), steps=2).count() == 0
