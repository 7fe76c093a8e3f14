"""Relabelling by quota, and removal of recovered vertices' edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.hashing import portable_uniform
from contactgraph.functions.joins import hot_join
from contactgraph.functions.ordering import TOP_ROWS, at_or_before, last_of_first
from contactgraph.schema import INFECTED, RECOVERED, SUSCEPTIBLE, VERTICES, Network, conform
from contactgraph.session import cut_lineage


def prune_edges(edges: DataFrame, recovered: DataFrame, canonical: bool = False) -> DataFrame:
    """Edges that touch none of the ``recovered`` ids, each once;
    ``canonical=True`` vouches that there are no duplicates to remove."""
    ids = recovered.select("id")
    kept = hot_join(edges, ids.withColumnRenamed("id", "src"), "src", "left_anti")
    kept = hot_join(kept, ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    kept = kept.select("src", "dst")
    return kept if canonical else kept.distinct()


def rank_order(score: str = "score", key: str = "id") -> list:
    """Highest score first, by the score rounded to 12 places so that the last
    bits of a sum cannot change the pick; then the lower id."""
    return [-F.round(F.col(score), 12), F.col(key)]


def relabel(
    net: Network,
    scores: DataFrame,
    n_infected: int,
    n_recovered: int,
    seed,
    top_rows: int = TOP_ROWS,
) -> Network:
    """The ``n_infected`` best-scored susceptibles become infected (score 1) and
    ``n_recovered`` random ones of those infected before become recovered
    (score 0, edges removed). Others take their new score, or keep the old
    one when they have none. Finds both cut points when called."""
    new = scores.select("id", F.col("score").alias("new_score"))
    rows = cut_lineage(net.vertices.join(new, "id", "left"))
    scored = F.col("new_score").isNotNull()
    susceptible = scored & ~F.col("health_status").isin(INFECTED, RECOVERED)
    infected = scored & (F.col("health_status") == INFECTED)

    best = rank_order("new_score")
    draw = [portable_uniform(seed, F.lit("recover"), F.col("id")), F.col("id")]
    best_cut = last_of_first(rows.filter(susceptible), n_infected, *best, top_rows=top_rows)
    draw_cut = last_of_first(rows.filter(infected), n_recovered, *draw, top_rows=top_rows)
    falls_ill = susceptible & at_or_before(best, best_cut)
    recovers = infected & at_or_before(draw, draw_cut)

    score = (
        F.when(falls_ill, F.lit(1.0))
        .when(recovers, F.lit(0.0))
        .otherwise(F.coalesce("new_score", "score"))
    )
    status = (
        F.when(falls_ill, F.lit(INFECTED))
        .when(recovers, F.lit(RECOVERED))
        .otherwise(F.col("health_status"))
    )
    vertices = conform(
        rows.select("id", score.alias("score"), status.alias("health_status")), VERTICES
    )
    return Network(vertices, prune_edges(net.edges, rows.filter(recovers), canonical=True))


def observed_counts(vertices: DataFrame, *by: str) -> DataFrame:
    """Vertices per health status, per group of ``by``."""

    def count(status: int, name: str):
        return F.count_if(F.col("health_status") == status).alias(name)

    return vertices.groupBy(*by).agg(
        count(SUSCEPTIBLE, "n_s"), count(INFECTED, "n_i"), count(RECOVERED, "n_r")
    )
