"""Contact-graph scoring: active part, adjacency, softmax random walk."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.components import connected_components
from contactgraph.functions.joins import hot_join
from contactgraph.functions.sums import exact_sum
from contactgraph.operators.sparse import SparseVec, vec_constant_on, vec_outer
from contactgraph.schema import RECOVERED, Network
from contactgraph.session import cut_lineage, partition_count

# A vertex is a hub when it holds more than this share of all link ends and
# more than HUB_LINKS of them. Shares sum to one, so there are at most
# 1 / HUB_SHARE hubs and their rows may be collected and broadcast.
HUB_SHARE = 1e-5
HUB_LINKS = 1_000_000


def active_vertices(vertices: DataFrame, cond: Column | None = None) -> DataFrame:
    """Vertices that take part: not recovered, or those meeting ``cond``."""
    return vertices.filter((F.col("health_status") != RECOVERED) if cond is None else cond)


def score_vector(
    vertices: DataFrame, cond: Column | None = None
) -> tuple[DataFrame, SparseVec]:
    """The filtered vertices and their scores as a vector sized by their count."""
    kept = active_vertices(vertices, cond)
    entries = kept.select(F.col("id").alias("i"), F.col("score").alias("value"))
    return kept, SparseVec(entries, kept.count())


def vector_to_scores(v: SparseVec) -> DataFrame:
    return v.df.select(F.col("i").alias("id"), F.col("value").alias("score"))


def active_edges(net: Network, scope: str = "both") -> DataFrame:
    """Edges with both ends active, or with at least one (``scope="either"``)."""
    active = active_vertices(net.vertices).select("id")
    if scope == "both":
        by_src = hot_join(net.edges, active.withColumnRenamed("id", "src"), "src", "left_semi")
        kept = hot_join(by_src, active.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return kept.select("src", "dst")
    if scope != "either":
        raise ValueError(f"scope must be 'both' or 'either', got {scope!r}")
    marks = active.withColumn("hit", F.lit(True))
    src = marks.select(F.col("id").alias("src"), F.col("hit").alias("src_hit"))
    dst = marks.select(F.col("id").alias("dst"), F.col("hit").alias("dst_hit"))
    return (
        hot_join(hot_join(net.edges, src, "src", "left"), dst, "dst", "left")
        .filter(F.col("src_hit").isNotNull() | F.col("dst_hit").isNotNull())
        .select("src", "dst")
    )


def both_directions(edges: DataFrame) -> DataFrame:
    """``(i, j)`` and ``(j, i)`` for every edge, read once."""
    ends = F.array(
        F.struct(F.col("src").alias("i"), F.col("dst").alias("j")),
        F.struct(F.col("dst").alias("i"), F.col("src").alias("j")),
    )
    return edges.select(F.explode(ends).alias("e")).select("e.i", "e.j")


def isolated_vertices(net: Network, scope: str = "both") -> DataFrame:
    """Active vertices in no active edge."""
    touched = both_directions(active_edges(net, scope)).select(F.col("i").alias("id")).distinct()
    return active_vertices(net.vertices).join(touched, "id", "left_anti")


def _artificial_edges(net: Network, scope: str) -> DataFrame:
    """Isolated vertex to every other active vertex."""
    active = active_vertices(net.vertices).select("id")
    isolated = isolated_vertices(net, scope).select("id")
    size = active.count()
    grid = vec_outer(vec_constant_on(isolated, 1.0, size), vec_constant_on(active, 1.0, size))
    return grid.df.select("i", "j").filter(F.col("i") != F.col("j"))


def closed_adjacency(
    net: Network, scope: str = "both", materialise: bool = False
) -> DataFrame:
    """``(i, j, value=1.0)`` over active vertices: edges both ways and a self
    loop each. ``materialise`` adds the rows of isolated vertices, which reach
    everyone; the walk never needs them."""
    links = both_directions(_weighted_edges(net, scope))
    active = active_vertices(net.vertices)
    parts = links.unionByName(active.select(F.col("id").alias("i"), F.col("id").alias("j")))
    if materialise:
        parts = parts.unionByName(_artificial_edges(net, scope))
    return parts.withColumn("value", F.lit(1.0))


def _weighted_edges(net: Network, scope: str) -> DataFrame:
    # a recovered end keeps its neighbour from being isolated under "either",
    # but carries no weight, so only edges between active vertices enter
    if scope not in ("both", "either"):
        raise ValueError(f"scope must be 'both' or 'either', got {scope!r}")
    return active_edges(net, "both")


def transition_matrix(
    net: Network, alpha: float = -2.0, scope: str = "both", isolated_rows: bool = False
) -> DataFrame:
    """Row-stochastic ``(i, j, value)``: from i to j with weight exp(alpha·score_j)
    among i's closed neighbourhood.

    The rows of isolated vertices are all alike and cover all active vertices;
    :func:`isolated_shares` gives them once. ``isolated_rows=True`` spells them
    out, which takes a row per isolated and active vertex. Writes the edges.
    """
    edges = cut_lineage(_weighted_edges(net, scope))
    weights = _weights(net, alpha)
    by_target = hot_join(
        both_directions(edges), weights.select(F.col("id").alias("j"), "weight"), "j"
    )
    around = by_target.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("around"))
    if scope == "either":
        touched = both_directions(net.edges).select(F.col("i").alias("id")).distinct()
        linked = weights.join(touched, "id", "left_semi").join(around, "id", "left")
    else:
        linked = weights.join(around, "id")
    linked = cut_lineage(
        linked.select("id", "weight", (F.coalesce("around", F.lit(0.0)) + F.col("weight")).alias("total"))
    )
    totals = linked.select(F.col("id").alias("i"), "total")
    rows = hot_join(by_target, totals, "i").select(
        "i", "j", (F.col("weight") / F.col("total")).alias("value")
    )
    loops = linked.select(
        F.col("id").alias("i"), F.col("id").alias("j"), (F.col("weight") / F.col("total")).alias("value")
    )
    rows = rows.unionByName(loops)
    if not isolated_rows:
        return rows
    shares = isolated_shares(net, alpha).select(F.col("id").alias("i"), F.col("share").alias("value"))
    size = weights.count()
    isolated = isolated_vertices(net, scope).select("id")
    alike = vec_outer(vec_constant_on(isolated, 1.0, size), SparseVec(shares, size))
    return rows.unionByName(alike.df)


def _weights(net: Network, alpha: float) -> DataFrame:
    return active_vertices(net.vertices).select(
        "id", F.exp(F.lit(float(alpha)) * F.col("score")).alias("weight")
    )


def isolated_shares(net: Network, alpha: float = -2.0) -> DataFrame:
    """``(id, share)``: the row of the transition matrix that every vertex of
    :func:`isolated_vertices` has, each active vertex's share of all weight.
    One row per vertex, however many are isolated."""
    weights = _weights(net, alpha)
    total = weights.agg(F.sum("weight")).first()[0]
    return weights.select("id", (F.col("weight") / F.lit(total or 1.0)).alias("share"))


class _Neighbours:
    """Adjacency laid out for repeated neighbour sums.

    Links of ordinary vertices are kept hash-partitioned and sorted by their
    source, so a sum needs one shuffle: that of the partial sums by target.
    Links of hubs stay where they are and meet the hubs' values by broadcast,
    which is bounded because the number of hubs is (see HUB_SHARE).
    """

    def __init__(self, links, degrees, n_links: int, partitions: int, hub_links: int, hold, exact: bool = False):
        self.exact = exact
        limit = max(hub_links, int(n_links * HUB_SHARE))
        found = []
        if n_links > limit:
            found = degrees.filter(F.col("degree") > limit).select("id").collect()
        self.hubs = self.hub_links = None
        ordinary = links
        if found:
            self.hubs = links.sparkSession.createDataFrame(found, "id long")
            ids = F.broadcast(self.hubs.withColumnRenamed("id", "i"))
            ordinary = links.join(ids, "i", "left_anti")
            self.hub_links = hold(links.join(ids, "i", "left_semi"))
            self.hub_links.count()
        loops = degrees.select(F.col("id").alias("i"), F.col("id").alias("j"))
        self.links = hold(
            ordinary.unionByName(loops).repartition(partitions, "i").sortWithinPartitions("i")
        )
        self.links.count()

    def sums(self, x: DataFrame) -> DataFrame:
        """``(id, total)``: for each vertex the sum of ``x`` over its closed
        neighbourhood; ``x`` has columns ``(id, x)``."""
        values = x.select(F.col("id").alias("i"), "x")
        terms = self.links.join(values, "i").select("j", "x")
        if self.hubs is not None:
            at_hubs = values.join(
                F.broadcast(self.hubs.withColumnRenamed("id", "i")), "i", "left_semi"
            )
            # a self loop of a hub is among self.links
            terms = terms.unionByName(
                self.hub_links.join(F.broadcast(at_hubs), "i").select("j", "x")
            )
        if self.exact:
            return exact_sum(terms, "j", value="x").select(F.col("j").alias("id"), F.col("x").alias("total"))
        return terms.groupBy(F.col("j").alias("id")).agg(F.sum("x").alias("total"))


def _walk_vertices(net: Network, links: DataFrame, alpha: float, scope: str) -> DataFrame:
    """``(id, weight, degree)`` of active vertices; no degree when isolated."""
    degrees = links.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("degree"))
    active = active_vertices(net.vertices).select(
        "id", F.exp(F.lit(float(alpha)) * F.col("score")).alias("weight")
    )
    if scope == "either":
        # linked to recovered vertices only: not isolated, stays where it is
        touched = both_directions(net.edges).select(F.col("i").alias("id")).distinct()
        lone = active.select("id").join(touched, "id", "left_semi").join(degrees, "id", "left_anti")
        degrees = degrees.unionByName(lone.withColumn("degree", F.lit(0).cast("long")))
    return active.join(degrees, "id", "left")


def walk_rank(
    net: Network,
    alpha: float = -2.0,
    steps: int = 10,
    scope: str = "both",
    cut_every: int = 5,
    hub_links: int = HUB_LINKS,
    links_per_partition: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """``(id, r)`` after ``steps`` steps of the softmax walk from the uniform
    start, over active vertices; r sums to 1.

    A walker at i moves within i's closed neighbourhood, to j with weight
    ``exp(alpha·score_j)``; from an isolated vertex it may move to anyone. No
    one moves to an isolated vertex except from isolated ones, so their share
    has a closed form and only linked vertices are iterated. The links are laid
    out in as many partitions as their number takes at ``links_per_partition``
    (default as for other tables), not fewer than the session's setting.
    ``exact`` makes all sums the same to the last bit however the rows are spread.
    Computes the walk when called.
    """
    if steps < 0 or cut_every < 1:
        raise ValueError("steps must be >= 0 and cut_every >= 1")
    spark = net.vertices.sparkSession
    held = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    try:
        links = both_directions(cut_lineage(_weighted_edges(net, scope)))
        vertices = cut_lineage(_walk_vertices(net, links, alpha, scope))
        n, n_links, n_isolated, weight, isolated_weight = vertices.agg(
            F.count("*"),
            F.coalesce(F.sum("degree"), F.lit(0)),
            F.count_if(F.col("degree").isNull()),
            F.coalesce(F.sum("weight"), F.lit(0.0)),
            F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("weight"))), F.lit(0.0)),
        ).first()
        if exact:
            sides = exact_sum(vertices.select(F.col("degree").isNull().alias("alone"), "weight"), "alone", value="weight")
            sums = {r["alone"]: r["weight"] for r in sides.collect()}
            isolated_weight = sums.get(True, 0.0)
            weight = sums.get(False, 0.0) + isolated_weight
        linked = vertices.filter(F.col("degree").isNotNull())
        start = 1.0 / n if n else 0.0
        # per unit of weight, what each vertex gets from the isolated ones
        gifts = [
            (n_isolated * start / weight) * (isolated_weight / weight) ** k if n else 0.0
            for k in range(steps)
        ]
        rank = linked.select("id", F.lit(start).alias("r"))
        if n > n_isolated and steps:
            degrees = linked.select("id", "degree")
            partitions = partition_count(spark, n_links + n, links_per_partition)
            near = _Neighbours(links, degrees, n_links, partitions, hub_links, hold, exact)
            around = near.sums(linked.select("id", F.col("weight").alias("x")))
            base = hold(
                linked.select("id", "weight")
                .join(around, "id")
                .select("id", "weight", (1.0 / F.col("total")).alias("scale"))
                .repartition(partitions, "id")
                .sortWithinPartitions("id")
            )
            base.count()
            x = base.select("id", (F.lit(start) * F.col("scale")).alias("x"))
            for k, gift in enumerate(gifts, start=1):
                moved = base.join(near.sums(x), "id").select(
                    "id", "scale", (F.col("weight") * (F.col("total") + F.lit(gift))).alias("r")
                )
                if k == steps:
                    rank = moved.select("id", "r")
                    break
                x = moved.select("id", (F.col("r") * F.col("scale")).alias("x"))
                # hub values are read twice per step, so the plan would double
                if k % cut_every == 0 or near.hubs is not None:
                    x = cut_lineage(x)
        apart = vertices.filter(F.col("degree").isNull())
        alone = F.col("weight") * F.lit(gifts[-1]) if steps else F.lit(start)
        return cut_lineage(rank.unionByName(apart.select("id", alone.alias("r"))))
    finally:
        for df in held:
            df.unpersist()


def walk_limit(net: Network, alpha: float = -2.0, scope: str = "both") -> DataFrame:
    """``(id, r)`` that :func:`walk_rank` comes to after ever more steps, without
    taking them.

    A step from i to j is as likely, weighed by weight times neighbourhood weight,
    as one from j to i, so within a connected component the limit is in proportion
    to that product; loops see to it that there is one. A component holds the share
    of walkers that started in it, and by weight of those that started isolated,
    who all leave in the end unless everyone is isolated. So it takes the
    components, whose rounds grow with the logarithm of the largest, and a few
    sums, where steps grow with how slowly the walk mixes. Runs jobs.
    """
    edges = cut_lineage(_weighted_edges(net, scope))
    links = both_directions(edges)
    vertices = cut_lineage(_walk_vertices(net, links, alpha, scope))
    n, n_isolated, weight, isolated_weight = vertices.agg(
        F.count("*"),
        F.count_if(F.col("degree").isNull()),
        F.coalesce(F.sum("weight"), F.lit(0.0)),
        F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("weight"))), F.lit(0.0)),
    ).first()
    alone = vertices.filter(F.col("degree").isNull())
    if n == n_isolated:
        return alone.select("id", (F.col("weight") / F.lit(weight or 1.0)).alias("r"))
    linked = vertices.filter(F.col("degree").isNotNull()).select("id", "weight")
    by_target = hot_join(links, linked.select(F.col("id").alias("j"), "weight"), "j")
    around = by_target.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("around"))
    named = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    placed = cut_lineage(
        linked.join(around, "id", "left")
        .join(named.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "id",
            "weight",
            (F.col("weight") * (F.coalesce("around", F.lit(0.0)) + F.col("weight"))).alias("pull"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    start = 1.0 / n
    from_isolated = n_isolated * start / (weight - isolated_weight)
    held = placed.groupBy("component").agg(
        F.sum("pull").alias("pulls"), (F.count("*") * F.lit(start) + F.sum("weight") * F.lit(from_isolated)).alias("held")
    )
    rank = hot_join(placed, held, "component").select("id", (F.col("held") * F.col("pull") / F.col("pulls")).alias("r"))
    return rank.unionByName(alone.select("id", F.lit(0.0).alias("r")))


def rescore(
    net: Network,
    alpha: float = -2.0,
    steps: int | None = 10,
    scope: str = "both",
    cut_every: int = 5,
    hub_links: int = HUB_LINKS,
) -> DataFrame:
    """``(id, score)`` with ``score + (1 - score)·r`` for active vertices, r being
    that after ``steps`` steps, or with None that of :func:`walk_limit`."""
    if steps is None:
        rank = walk_limit(net, alpha, scope)
    else:
        rank = walk_rank(net, alpha, steps, scope, cut_every, hub_links)
    return (
        active_vertices(net.vertices)
        .join(rank, "id")
        .select("id", (F.col("score") + (1.0 - F.col("score")) * F.col("r")).alias("score"))
    )
