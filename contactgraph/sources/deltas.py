"""Snapshots of which only the changes are written.

Every written step is a folder of its own below ``<base>/data`` and, last of all,
one row in the table ``<base>/manifest``: its version, the version its changes are
against (null for a whole network), and its counts. Nothing is ever replaced: a
step that is written again gets a new version, older versions and what was built
on them stay readable, and a folder without a row in the manifest does not exist
for readers. Folders are named below ``base``, so all of it may be moved. One
writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactgraph.schema import EDGES, INFECTED, RECOVERED, SUSCEPTIBLE, VERTICES, Network, conform

_STATUS = {"n_s": SUSCEPTIBLE, "n_i": INFECTED, "n_r": RECOVERED}
_COUNTS = [*_STATUS, "n_edges"]
_MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("parent", T.LongType()),
        T.StructField("folder", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in _COUNTS],
    ]
)
# a changed row, whether it is gone, and the status it had before
_MARKS = [T.StructField("gone", T.BooleanType()), T.StructField("version", T.LongType())]
_STORED = {
    "vertices": T.StructType([*VERTICES.fields, T.StructField("was", T.IntegerType()), *_MARKS]),
    "edges": T.StructType([*EDGES.fields, *_MARKS]),
}
_KEYS = {"vertices": ["id"], "edges": ["src", "dst"]}


def _manifest(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{base}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _newest(rows, step: int):
    found = [r for r in rows if r["step"] == step]
    if not found:
        raise ValueError(f"step {step} has not been written")
    return max(found, key=lambda r: r["version"])


def _chain(rows, last) -> list:
    """The whole network that a version goes back to and the changes since."""
    by_version = {r["version"]: r for r in rows}
    chain = [last]
    while chain[-1]["parent"] is not None:
        chain.append(by_version[chain[-1]["parent"]])
    return chain[::-1]


def _merged(spark: SparkSession, base: str, chain: list, table: str) -> DataFrame:
    """The last state of every row. Only changes are grouped; rows of the whole
    network stay where they are when changes are few enough for Spark to broadcast."""

    def read(rows):
        return spark.read.schema(_STORED[table]).parquet(*[f"{base}/{r['folder']}/{table}" for r in rows])

    keys, whole = _KEYS[table], read(chain[:1])
    values = [f.name for f in (VERTICES if table == "vertices" else EDGES)]
    if len(chain) == 1:
        return whole.select(*values)
    rest = [v for v in values if v not in keys]
    last = F.max(F.struct("version", "gone", *rest)).alias("last")
    changed = read(chain[1:]).groupBy(*keys).agg(last)
    kept = whole.join(changed.select(*keys), keys, "left_anti").select(*values)
    new = changed.filter(~F.col("last.gone")).select(*keys, *[F.col(f"last.{v}").alias(v) for v in rest])
    return kept.unionByName(new)


def _network(spark: SparkSession, base: str, chain: list) -> Network:
    vertices, edges = (_merged(spark, base, chain, table) for table in _STORED)
    return Network(conform(vertices, VERTICES), conform(edges, EDGES))


def read_step(spark: SparkSession, base: str, step: int) -> Network:
    """The network of the newest version of one step."""
    base = base.rstrip("/")
    rows = _manifest(spark, base).collect()  # one row per written step
    return _network(spark, base, _chain(rows, _newest(rows, step)))


def _vertex_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    before = old.select("id", F.struct("score", "health_status").alias("o"))
    after = new.select("id", F.struct("score", "health_status").alias("n"))
    both = before.join(after, "id", "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    return both.select(
        "id", "n.score", "n.health_status", F.col("o.health_status").alias("was"), F.col("n").isNull().alias("gone")
    )


def _edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    before = old.select("src", "dst", F.lit(True).alias("o"))
    after = new.select("src", "dst", F.lit(True).alias("n"))
    both = before.join(after, ["src", "dst"], "full").filter(F.col("o").isNull() | F.col("n").isNull())
    return both.select("src", "dst", F.col("n").isNull().alias("gone"))


def _counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """How the counts change by the rows of one folder, from those rows alone."""
    vertices = spark.read.schema(_STORED["vertices"]).parquet(f"{folder}/vertices")
    edges = spark.read.schema(_STORED["edges"]).parquet(f"{folder}/edges")
    moved = [
        (F.count_if(F.col("health_status") == s) - F.count_if(F.col("was") == s)).alias(name)
        for name, s in _STATUS.items()
    ]
    linked = (F.count_if(~F.col("gone")) - F.count_if(F.col("gone"))).alias("n_edges")
    return {**vertices.agg(*moved).first().asDict(), **edges.agg(linked).first().asDict()}


def _commit(spark: SparkSession, base: str, row: dict) -> None:
    # one row is one file, which appears whole or not at all
    line = spark.createDataFrame([tuple(row[f.name] for f in _MANIFEST)], _MANIFEST)
    line.coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def write_step(net: Network, base: str, step: int, parent: int | None = None) -> int:
    """Write a network as ``step`` and return its version.

    With ``parent``, a step written before, only the rows that differ from its
    newest version are written, and the counts are the parent's, moved by those
    rows. Ids and edges must be unique. Until the last write readers see what they
    saw before. The number of steps since the last whole network is the caller's
    choice: ``parent=None`` starts anew.
    """
    if step < 0:
        raise ValueError(f"step must not be negative, got {step}")
    spark, base = net.vertices.sparkSession, base.rstrip("/")
    rows = _manifest(spark, base).collect()
    version = max((r["version"] for r in rows), default=0) + 1
    folder = f"data/{uuid.uuid4().hex}"
    start = dict.fromkeys(_COUNTS, 0)
    origin = None
    if parent is None:
        here = F.lit(False).alias("gone")
        tables = {
            "vertices": net.vertices.select(*VERTICES.names, F.lit(None).cast("int").alias("was"), here),
            "edges": net.edges.select(*EDGES.names, here),
        }
    else:
        origin = _newest(rows, parent)
        start = {name: origin[name] for name in _COUNTS}
        old = _network(spark, base, _chain(rows, origin))
        tables = {
            "vertices": _vertex_changes(old.vertices, net.vertices),
            "edges": _edge_changes(old.edges, net.edges),
        }
    for table, df in tables.items():
        # sorted files give narrow row-group ranges at no shuffle
        sorted_rows = df.withColumn("version", F.lit(version)).sortWithinPartitions(*_KEYS[table])
        conform(sorted_rows, _STORED[table]).write.parquet(f"{base}/{folder}/{table}")
    moved = _counts(spark, f"{base}/{folder}")
    row = {"version": version, "step": step, "parent": origin and origin["version"], "folder": folder}
    _commit(spark, base, row | {name: start[name] + moved[name] for name in _COUNTS})
    return version


def kept_counts(spark: SparkSession, base: str) -> DataFrame:
    """``(step, n_s, n_i, n_r, n_edges)`` of all steps, kept with the manifest: no
    vertices and no edges are read."""
    last = F.max(F.struct("version", *_COUNTS)).alias("last")
    grouped = _manifest(spark, base.rstrip("/")).groupBy("step").agg(last)
    return grouped.select("step", *[F.col(f"last.{name}").alias(name) for name in _COUNTS])
