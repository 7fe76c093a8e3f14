"""Table schemas and the ``Network`` pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Health status codes.
INFECTED = 1
SUSCEPTIBLE = 0
RECOVERED = -1

VERTICES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("health_status", T.IntegerType(), False),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("src", T.LongType(), False),
        T.StructField("dst", T.LongType(), False),
    ]
)

SCENARIOS = T.StructType(
    [
        T.StructField("scenario_id", T.LongType(), False),
        T.StructField("beta", T.DoubleType(), False),
        T.StructField("gamma", T.DoubleType(), False),
        T.StructField("n", T.LongType(), False),
        T.StructField("i0", T.DoubleType(), False),
        T.StructField("r0", T.DoubleType(), False),
        T.StructField("t_end", T.IntegerType(), False),
        T.StructField("step_size", T.DoubleType(), False),
    ]
)

QUOTAS = T.StructType(
    [
        T.StructField("scenario_id", T.LongType(), False),
        T.StructField("step", T.IntegerType(), False),
        T.StructField("new_infected", T.IntegerType(), False),
        T.StructField("new_recovered", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class Network:
    """Vertices ``(id, score, health_status)`` and canonical edges ``(src, dst)``.

    Canonical means ``src < dst`` and no duplicates; an edge is read in both
    directions. Use :func:`network` to build one from raw tables.
    """

    vertices: DataFrame
    edges: DataFrame


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, have {df.columns}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected form: ``src < dst``, one row per pair, no self loops."""
    return (
        conform(edges, EDGES)
        .filter(F.col("src") != F.col("dst"))
        .select(
            F.least("src", "dst").alias("src"),
            F.greatest("src", "dst").alias("dst"),
        )
        .distinct()
    )


def network(vertices: DataFrame, edges: DataFrame, canonical: bool = False) -> Network:
    """Build a :class:`Network`; ``canonical=True`` vouches for the edges and
    saves the shuffle that removes duplicates."""
    return Network(
        conform(vertices, VERTICES),
        conform(edges, EDGES) if canonical else canonical_edges(edges),
    )


def check_network(net: Network) -> DataFrame:
    """One row of violation counts; all zero for a valid network."""
    vertices = net.vertices.groupBy("id").agg(
        F.count("*").alias("copies"),
        F.count_if(
            ~F.col("health_status").isin(INFECTED, SUSCEPTIBLE, RECOVERED)
            | ~F.col("score").between(0.0, 1.0)
        ).alias("bad_values"),
    )
    edges = net.edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
    counts = vertices.select(
        F.when(F.col("copies") > 1, 1).otherwise(0).alias("duplicate_vertices"),
        F.col("bad_values"),
        F.lit(0).alias("duplicate_edges"),
        F.lit(0).alias("unordered_edges"),
    ).unionByName(
        edges.select(
            F.lit(0).alias("duplicate_vertices"),
            F.lit(0).cast("long").alias("bad_values"),
            F.when(F.col("copies") > 1, 1).otherwise(0).alias("duplicate_edges"),
            F.when(F.col("src") >= F.col("dst"), 1).otherwise(0).alias("unordered_edges"),
        )
    )
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns])
