import pytest
from networks import make, random_network
from pyspark.sql import functions as F

from contactgraph.operators import curves
from contactgraph.schema import EDGES, QUOTAS, VERTICES, check_network
from contactgraph.session import fresh_folder
from contactgraph.sources import snapshots


def content(net):
    return (
        sorted(tuple(r) for r in net.vertices.collect()),
        sorted(tuple(r) for r in net.edges.collect()),
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip_and_history(spark, fmt):
    base = fresh_folder(spark, "test")
    nets = [make(spark, *random_network(seed)) for seed in (31, 32)]
    for step, net in enumerate(nets):
        snapshots.write_snapshot(net, base, step, fmt)
    for step, net in enumerate(nets):
        back = snapshots.read_snapshot(spark, base, step, fmt)
        assert content(back) == content(net)
        assert back.vertices.dtypes == [(f.name, f.dataType.simpleString()) for f in VERTICES]
        assert back.edges.dtypes == [(f.name, f.dataType.simpleString()) for f in EDGES]
    vertices, edges = snapshots.read_history(spark, base, fmt)
    assert vertices.filter("step = 1").count() == nets[1].vertices.count()
    seen = {r["step"]: (r["n_s"], r["n_i"], r["n_r"]) for r in curves.observed_curve(vertices).collect()}
    assert sum(seen[0]) == nets[0].vertices.count()
    assert set(seen) == {r["step"] for r in edges.select("step").distinct().collect()} == {0, 1}


def test_foreign_csv(spark):
    base = fresh_folder(spark, "test")
    spark.createDataFrame([("1,0.5,1.0",), ("2,0.0,-1.0",)], "line string").write.text(f"{base}/v.csv")
    spark.createDataFrame([("2,1",), ("1,2",)], "line string").write.text(f"{base}/e.csv")
    net = snapshots.read_tables(spark, f"{base}/v.csv", f"{base}/e.csv")
    assert content(net) == ([(1, 0.5, 1), (2, 0.0, -1)], [(1, 2)])


def test_refuses_to_overwrite_its_input(spark):
    net = make(spark, *random_network(33, n=5, m=3))
    base = fresh_folder(spark, "test")
    with pytest.raises(ValueError):
        snapshots.write_snapshot(net, base, 2, input_step=2)
    with pytest.raises(ValueError):
        snapshots.write_snapshot(net, base, 0, fmt="orc")


def test_half_written_steps_are_not_read(spark, monkeypatch):
    net = make(spark, *random_network(34, n=8, m=6))
    base = fresh_folder(spark, "test")
    for step in (0, 1):
        snapshots.write_snapshot(net, base, step)

    def broken(self, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(net.edges), "sortWithinPartitions", lambda df, *c: df)
    monkeypatch.setattr(type(net.edges.write), "save", broken)
    with pytest.raises(RuntimeError):
        snapshots.write_snapshot(net, base, 1)
    monkeypatch.undo()
    assert snapshots.complete_steps(spark, base) == [0]
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, base, 1)
    assert {r["step"] for r in snapshots.read_history(spark, base)[0].select("step").collect()} == {0}
    snapshots.write_snapshot(net, base, 1)
    assert content(snapshots.read_snapshot(spark, base, 1)) == content(net)


def test_history_written_at_once(spark, tmp_path):
    base = str(tmp_path)
    vertices, edges = random_network(3)
    net = make(spark, vertices, edges)
    snapshots.write_snapshot(net, base, 7)
    v = net.vertices.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("step < 2 or id % 2 = 0")
    e = net.edges.withColumn("step", F.lit(1))
    for _ in range(2):  # again, in place of what was there
        snapshots.write_history(v, e, base)
        assert snapshots.complete_steps(spark, base) == [0, 1, 2, 7]
        held, links = snapshots.read_history(spark, base)
        counts = {r["step"]: r["count"] for r in held.groupBy("step").count().collect()}
        n = len(vertices)
        assert counts == {0: n, 1: n, 2: sum(i % 2 == 0 for i, *_ in vertices), 7: n}
        assert links.filter("step = 1").count() == net.edges.count() and links.filter("step = 0").count() == 0
    assert snapshots.read_snapshot(spark, base, 1).edges.count() == net.edges.count()
