"""Hard negatives against all inner products, the trees, and the edges."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contactgraph.llm import hard_negatives, oracles, queries
from contactgraph.llm.hard_negatives import Splits, Tree, exact, interval

TABLE = "vec_id bigint, embedding array<double>, label int, tile string, part string, score double"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "clash", "clash", 0.0) for i, v, y in rows], TABLE)


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90):
    good = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i, tuple(int(np.floor(256.0 * x)) for x in v), y] = None
    found = []
    for i, v, y in good:
        if i % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in good if j != i and len(w) == len(v)
        )
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            found += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(inside, start=1)]
    return sorted(found)


def mined(spark, rows, **options):
    every = options.pop("every", 100)
    df = hard_negatives.mine(table_of(spark, rows), F.col("id") % every == 0, **options)
    return sorted(map(tuple, df.collect()))


def clustered(n, width, labels, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, width)) + 0.5
    y = rng.integers(0, labels, n)
    return [(i, (centres[y[i]] + spread * rng.standard_normal(width)).tolist(), int(y[i])) for i in range(n)]


@pytest.mark.parametrize(
    "n, width, labels, options",
    [(400, 8, 3, {}), (1_500, 3, 2, dict(block_values=300, sample=200)), (900, 16, 40, dict(block_values=2_000, sample=64))],
)
def test_all_inner_products_agree(spark, n, width, labels, options):
    rows = clustered(n, width, labels, seed=n)
    expected = plain(rows, every=30)
    assert expected
    assert mined(spark, rows, every=30, **options) == expected


def test_ties_copies_nulls_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(1_000, 1_400)]  # a crowd of equal vectors
    rows += [(100, [2.0, 0.0, 1.0, 1.0], 1), (100, [2.0, 0.0, 1.0, 1.0], 1), (200, [0.5, 0.5, 2.0, 2.0], 2)]  # repeated ids
    rows += [(None, [1.0] * 4, 1), (400, None, 1), (500, [1.0] * 4, None), (600, [1.0, None, 1.0, 1.0], 1)]
    rows += [(700, [float("nan")] * 4, 1), (701, [float("inf"), 0.0, 0.0, 0.0], 2), (800, [], 1), (801, [], 2)]
    rows += [(900, [0.0] * 4, 1), (1_500, [1.0, 2.0], 1), (1_501, [1.0, 1.0], 1), (1_502, [1.0, 0.5], 2)]
    rows += [(1_600, [-3.0] * 4, 9), (1_601, [2.0] * 4, 9)]  # a negative positive has no window
    result = mined(spark, rows, block_values=400, sample=100)
    # a row of an id that came twice with different contents is an anchor of its own
    assert result == plain(rows)
    anchors = {r[0] for r in result}
    assert 100 in anchors and 1_500 in anchors and not anchors & {400, 500, 600, 700, 1_600}
    assert {r[3] for r in result if r[0] == 1_500} == {1_502}


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    for scale in (2.0**8, 2.0**16, 2.0**17):  # scores below 2**53, 2**62 and 2**63
        rows = [(i, (rng.integers(1, 50, 3) * scale + rng.integers(0, 9, 3) / 8).tolist(), i % 2) for i in range(60)]
        expected = plain(rows, every=20)
        assert expected and mined(spark, rows, every=20) == expected
    # beyond 64 bits scores are alike, and nothing fails
    assert mined(spark, [(i, [1e300, 1e200], i % 2) for i in range(4)], every=4) == []


def test_empty_and_single_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768)]


def test_bounds_hold_and_boxes_are_left_out():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-100, 100, (4_000, 3))
    labels = rng.integers(0, 2, 4_000)
    tree = Tree(np.arange(4_000), labels, vectors)
    assert tree.last[: tree.leaves].max() == 4_000
    asked = rng.integers(-100, 100, (5, 3))
    low, high = interval(asked, tree.low, tree.high)
    scores = tree.vectors @ asked.T
    for node in range(tree.leaves):
        part = scores[tree.first[node] : tree.last[node]].T
        assert (part >= low[:, [node]]).all() and (part <= high[:, [node]]).all()
    for q in range(5):
        everyone, opened = np.ones(len(tree.first), bool), []
        found = tree.search(
            lambda i, j: scores[i:j, q], low[q].tolist(), high[q].tolist(), everyone,
            lambda i, j: np.ones(j - i, bool), [(-(2**63), 2**63 - 1)], 5, opened,
        )
        best = sorted(zip(scores[:, q].tolist(), (-tree.ids).tolist()), reverse=True)[:5]
        assert found == [best]
        assert len(opened) < tree.leaves / 4


def test_every_row_has_a_tile_of_bounded_size():
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 1_000, (10_000, 6))
    labels = np.where(rng.random(10_000) < 0.5, 7, rng.integers(0, 300, 10_000))
    splits = Splits(labels, vectors, 100)
    tiles = splits.assign(labels, vectors)
    sizes = np.bincount(tiles, minlength=splits.tiles)
    assert sizes.sum() == 10_000 and 0 < sizes.max() <= 220 and splits.tiles < 300


def test_numbers_are_exact():
    for top in (10, 2**30, 2**45):
        a, b = exact(np.array([[top, top - 1]]), np.array([[top, -top]]))
        assert int((a @ b.T)[0, 0]) == top


def test_sql_and_query_agree(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    cursor = con.execute(oracles.oracle_sql()["op12_hard_negatives"])
    names = [d[0] for d in cursor.description]
    df = queries.op12_hard_negatives(spark, small)
    assert sorted(df.columns) == sorted(names)
    expected = sorted(cursor.fetchall())
    assert expected and sorted(map(tuple, df.select(*names).collect())) == expected
