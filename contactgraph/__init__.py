"""Contact networks on Spark: two DataFrames, vertices and edges, and the
DataFrame functions that score, relabel, link and snapshot them."""

from contactgraph.schema import (
    EDGES,
    INFECTED,
    QUOTAS,
    RECOVERED,
    SCENARIOS,
    SUSCEPTIBLE,
    VERTICES,
    Network,
    canonical_edges,
    network,
)

__all__ = [
    "EDGES",
    "INFECTED",
    "QUOTAS",
    "RECOVERED",
    "SCENARIOS",
    "SUSCEPTIBLE",
    "VERTICES",
    "Network",
    "canonical_edges",
    "network",
]
