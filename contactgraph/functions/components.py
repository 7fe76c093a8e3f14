"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.joins import hot_join
from contactgraph.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select(F.explode(F.expr(
        "array(struct(a as u, b as v), struct(b as u, a as v))")).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    tied = hot_join(both.filter("v > u"), least, "u")
    return tied.select(F.col("v").alias("a"), F.least("least", "u").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    tied = hot_join(down, least, "u")
    return (
        tied.select(F.col("v").alias("a"), F.col("least").alias("b"))
        .filter("a <> b")
        .union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (two bigint columns
    ``a``, ``b``); the component is the least node reachable.

    Large and small stars take turns until the edges are stars around the least
    nodes, which takes a number of rounds logarithmic in the largest component.
    Every round is written to the checkpoint folder; the driver sees a count and
    a checksum. Nodes of high degree meet only a pre-aggregated minimum, in a
    join that adaptive execution may split. Nulls, loops and repeated links are
    ignored; an empty table has no components.
    """
    edges = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state["n"] == 0 or tuple(state) == before:
            break
        before = tuple(state)
        edges = cut_lineage(_small_star(_large_star(edges)))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
