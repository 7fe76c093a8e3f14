"""Seeded initial labels and initial edges for any id table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.hashing import portable_uniform
from contactgraph.functions.ordering import TOP_ROWS, at_or_before, dense_index, first_k, last_of_first
from contactgraph.schema import (
    EDGES,
    INFECTED,
    RECOVERED,
    SUSCEPTIBLE,
    VERTICES,
    Network,
    conform,
)


def label_sample(
    ids: DataFrame, n_infected: int, n_recovered: int, seed, top_rows: int = TOP_ROWS
) -> DataFrame:
    """Vertices with ``n_infected`` random ids infected, another ``n_recovered``
    recovered, the rest susceptible; score 1 for infected, else 0.

    Two cut points in hash order are found first, so labelling is a projection.
    """
    if n_infected < 0 or n_recovered < 0:
        raise ValueError("counts must not be negative")
    order = [portable_uniform(seed, F.lit("label"), F.col("id")), F.col("id")]
    infected = last_of_first(ids, n_infected, *order, top_rows=top_rows)
    labelled = last_of_first(ids, n_infected + n_recovered, *order, top_rows=top_rows)
    status = (
        F.when(at_or_before(order, infected), F.lit(INFECTED))
        .when(at_or_before(order, labelled), F.lit(RECOVERED))
        .otherwise(F.lit(SUSCEPTIBLE))
    )
    labels = ids.select("id", status.alias("health_status"))
    score = F.when(F.col("health_status") == RECOVERED, 0.0).otherwise(F.col("health_status"))
    return conform(labels.withColumn("score", score), VERTICES)


def disjoint_pairs(ids: DataFrame, m: int, seed) -> DataFrame:
    """Edges joining m random ids one to one with m random others.

    No id is used twice; with fewer than m others there are fewer edges.
    """
    first = [portable_uniform(seed, F.lit("src"), F.col("id")), F.col("id")]
    second = [portable_uniform(seed, F.lit("dst"), F.col("id")), F.col("id")]
    cut = last_of_first(ids, m, *first)
    chosen = at_or_before(first, cut)
    left = ids.filter(chosen).select("id", first[0].alias("u"))
    right = first_k(ids.filter(~chosen), m, *second).select("id", second[0].alias("u"))
    left = dense_index(left, "u", "id").select(F.col("id").alias("a"), "idx")
    right = dense_index(right, "u", "id").select(F.col("id").alias("b"), "idx")
    pairs = left.join(right, "idx")
    return conform(
        pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")), EDGES
    )


def initial_network(
    ids: DataFrame, n_edges: int, n_infected: int, n_recovered: int, seed
) -> Network:
    """Random labels and random disjoint edges on the given ids."""
    return Network(
        label_sample(ids, n_infected, n_recovered, seed), disjoint_pairs(ids, n_edges, seed)
    )
