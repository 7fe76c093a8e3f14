"""Steps of which only the changes are written."""

import shutil

import pytest
from networks import make, plan_lines, random_network

from contactgraph.schema import Network
from contactgraph.sources import deltas


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def assert_same(got: Network, want: Network):
    assert rows(got.vertices) == rows(want.vertices)
    assert rows(got.edges) == rows(want.edges)


def counts(net):
    status = [r["health_status"] for r in net.vertices.collect()]
    return (status.count(0), status.count(1), status.count(-1), net.edges.count())


@pytest.fixture(scope="module")
def steps(spark):
    """Four networks: rows change, go, come and come back."""
    vertices, edges = random_network(3)
    gone = vertices[5][0]
    second = [(i, 0.0, -1) if k % 9 == 0 else (i, s, h) for k, (i, s, h) in enumerate(vertices)]
    third = [v for v in second if v[0] != gone] + [(1, 0.25, 0)]
    without = [e for e in edges[4:] if gone not in e]
    return [
        make(spark, vertices, edges),
        make(spark, second, edges[4:]),
        make(spark, third, [*without, (1, vertices[0][0])]),
        make(spark, second, edges),
    ]


@pytest.fixture(scope="module")
def written(steps, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("deltas"))
    for step, net in enumerate(steps):
        deltas.write_step(net, path, step, parent=step - 1 if step else None)
    return path


@pytest.fixture
def base(written, tmp_path):
    return shutil.copytree(written, str(tmp_path / "kept"))


def test_every_step_reads_as_it_was(spark, steps, base):
    for step, net in enumerate(steps):
        assert_same(deltas.read_step(spark, base, step), net)


def test_counts_are_kept_without_reading_vertices(spark, steps, base):
    kept = deltas.kept_counts(spark, base)
    assert rows(kept) == [(k, *counts(net)) for k, net in enumerate(steps)]
    assert kept.inputFiles() and all("/kept/manifest/" in path for path in kept.inputFiles())


def test_only_changed_rows_are_written(spark, steps, base):
    manifest = {r["step"]: r for r in deltas._manifest(spark, base).collect()}
    before = {r["id"]: tuple(r) for r in steps[0].vertices.collect()}
    changed = {r["id"] for r in steps[1].vertices.collect() if before[r["id"]] != tuple(r)}
    written = spark.read.parquet(f"{base}/{manifest[1]['folder']}/vertices").collect()
    assert {r["id"] for r in written} == changed and len(written) == len(changed)
    assert spark.read.parquet(f"{base}/{manifest[1]['folder']}/edges").count() == 4


def test_the_same_again_writes_no_rows(spark, steps, base):
    deltas.write_step(steps[3], base, 4, parent=3)
    assert_same(deltas.read_step(spark, base, 4), steps[3])
    last = deltas._newest(deltas._manifest(spark, base).collect(), 4)
    assert spark.read.parquet(f"{base}/{last['folder']}/vertices").count() == 0


def test_a_failure_between_writes_leaves_the_old_step(spark, steps, base, monkeypatch):
    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(deltas, "_commit", fails)
    for step, parent in ((2, 1), (4, 3), (0, None)):
        with pytest.raises(OSError):
            deltas.write_step(steps[1], base, step, parent=parent)
    monkeypatch.undo()
    for step, net in enumerate(steps):
        assert_same(deltas.read_step(spark, base, step), net)
    assert rows(deltas.kept_counts(spark, base)) == [(k, *counts(net)) for k, net in enumerate(steps)]
    with pytest.raises(ValueError):
        deltas.read_step(spark, base, 4)


def test_a_step_written_again_leaves_what_was_built_on_it(spark, steps, base):
    deltas.write_step(steps[0], base, 1, parent=0)  # the one steps 2 and 3 were not built on
    for step, net in enumerate([steps[0], steps[0], *steps[2:]]):
        assert_same(deltas.read_step(spark, base, step), net)
    # a whole network in the middle starts a new chain
    version = deltas.write_step(steps[2], base, 2)
    assert version == 6
    assert_same(deltas.read_step(spark, base, 2), steps[2])
    deltas.write_step(steps[3], base, 0, parent=2)  # read and written under one step's name
    assert_same(deltas.read_step(spark, base, 0), steps[3])


def test_empty_networks(spark, steps, tmp_path):
    base, empty = str(tmp_path / "empty"), make(spark, [], [])
    assert deltas.kept_counts(spark, base).count() == 0
    deltas.write_step(empty, base, 0)
    deltas.write_step(steps[0], base, 1, parent=0)
    deltas.write_step(empty, base, 2, parent=1)
    assert_same(deltas.read_step(spark, base, 1), steps[0])
    assert_same(deltas.read_step(spark, base, 2), empty)
    assert [tuple(r)[1:] for r in deltas.kept_counts(spark, base).orderBy("step").collect()] == [
        (0, 0, 0, 0),
        counts(steps[0]),
        (0, 0, 0, 0),
    ]


def test_wrong_steps(spark, steps, tmp_path):
    base = str(tmp_path / "none")
    with pytest.raises(ValueError):
        deltas.read_step(spark, base, 0)
    with pytest.raises(ValueError):
        deltas.write_step(steps[0], base, 1, parent=0)
    with pytest.raises(ValueError):
        deltas.write_step(steps[0], base, -1)


def test_extra_columns_are_left_out(spark, steps, tmp_path):
    base, net = str(tmp_path / "extra"), steps[0]
    wide = Network(
        net.vertices.selectExpr("*", "1 as gone", "2 as version", "3 as was", "4 as o"),
        net.edges.selectExpr("*", "1 as gone", "2 as version", "3 as n"),
    )
    deltas.write_step(wide, base, 0)
    deltas.write_step(wide, base, 1, parent=0)
    assert_same(deltas.read_step(spark, base, 1), net)


def test_the_whole_network_is_not_shuffled_for_few_changes(spark, steps, base):
    text = "\n".join(plan_lines(deltas.read_step(spark, base, 1).vertices))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    # the exchanges by id are those of the changes, once for the ids and once for the values
    assert text.count("Exchange hashpartitioning(id") == 2
