"""Rescoring after a change: the walk is kept step by step, and only what changed
travels.

Of the linked vertices two walks are kept, one that starts with 1 everywhere and
one that starts with the weights. The rank is the first times the start plus, for
every step, the second times what isolated vertices gave at that step; these
factors are numbers. So however many vertices come and go, the two walks change
only around the changes, and a change that has become small is let go.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.joins import hot_join
from contactgraph.operators.graph import active_edges, active_vertices, both_directions
from contactgraph.schema import EDGES, RECOVERED, VERTICES, Network, canonical_edges, conform
from contactgraph.session import cut_lineage

#: Most ids that are broadcast; more are shuffled.
LISTED = 100_000


@dataclass(frozen=True)
class WalkState:
    """A network and the walk on it.

    ``links`` are the active links in both directions and the loops of linked
    vertices; ``walks`` has ``(id, weight, total, u, v)`` of linked vertices, the
    arrays holding both walks after 0 to ``steps`` steps. ``touched`` counts the
    rows of changes that the last update sent on, step by step."""

    net: Network
    alpha: float
    steps: int
    links: DataFrame
    walks: DataFrame
    n: int
    n_isolated: int
    weight: float
    linked_weight: float
    touched: tuple[int, ...] = ()

    def rank(self) -> DataFrame:
        """``(id, r)`` as :func:`walk_rank` gives it."""
        start = 1.0 / self.n if self.n else 0.0
        lone_weight = self.weight - self.linked_weight if self.n_isolated else 0.0
        ratio = lone_weight / self.weight if self.weight else 0.0
        gifts = [self.n_isolated * start / self.weight * ratio**k if self.n_isolated else 0.0 for k in range(self.steps)]
        r = F.col("u")[self.steps] * F.lit(start)
        for k, gift in enumerate(gifts, start=1):
            r = r + F.col("v")[self.steps - k] * F.lit(gift)
        linked = self.walks.select("id", r.alias("r"))
        alone = _weighted(self.net, self.alpha).join(self.walks.select("id"), "id", "left_anti")
        share = F.col("weight") * F.lit(gifts[-1]) if self.steps else F.lit(start)
        return linked.unionByName(alone.select("id", share.alias("r")))


def _weighted(net: Network, alpha: float) -> DataFrame:
    return active_vertices(net.vertices).select("id", F.exp(F.lit(float(alpha)) * F.col("score")).alias("weight"))


def _few(df: DataFrame) -> DataFrame:
    """``df``, written, and broadcast where its rows are few."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= LISTED else df


def _sizes(net: Network, alpha: float, walks: DataFrame) -> dict:
    n, weight = _weighted(net, alpha).agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    linked, linked_weight = walks.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    return dict(n=n, n_isolated=n - linked, weight=weight, linked_weight=linked_weight)


def walk_state(net: Network, alpha: float = -2.0, steps: int = 10) -> WalkState:
    """Walk ``steps`` steps on the whole network and keep them."""
    if steps < 1:
        raise ValueError("steps must be positive")
    edges = cut_lineage(active_edges(net, "both"))
    linked = cut_lineage(both_directions(edges).select(F.col("i").alias("id")).distinct())
    links = cut_lineage(both_directions(edges).unionByName(linked.select(F.col("id").alias("i"), F.col("id").alias("j"))))
    weights = _weighted(net, alpha).join(linked, "id")
    total = hot_join(links, weights.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("total"))
    walks = cut_lineage(
        weights.join(total, "id").select("id", "weight", "total", F.array(F.lit(1.0)).alias("u"), F.array("weight").alias("v"))
    )
    for k in range(steps):
        values = walks.select(F.col("id").alias("i"), *[(F.col(c)[k] / F.col("total")).alias(f"z{c}") for c in "uv"])
        sums = hot_join(links, values, "i").groupBy(F.col("j").alias("id")).agg(F.sum("zu").alias("zu"), F.sum("zv").alias("zv"))
        grown = [F.concat(c, F.array(F.col("weight") * F.col(f"z{c}"))).alias(c) for c in "uv"]
        walks = cut_lineage(walks.join(sums, "id").select("id", "weight", "total", *grown))
    return WalkState(net, alpha, steps, links, walks, **_sizes(net, alpha, walks))


def _among(df: DataFrame, ids: DataFrame, *cols: str) -> DataFrame:
    """Rows of ``df`` of which any of ``cols`` is among the few ``ids``."""
    hit = F.lit(False)
    for c in cols:
        df = df.join(ids.select(F.col("id").alias(c), F.lit(True).alias(f"_in_{c}")), c, "left")
        hit = hit | F.col(f"_in_{c}").isNotNull()
    return df.filter(hit).drop(*[f"_in_{c}" for c in cols])


def update_walk(
    state: WalkState,
    vertices: DataFrame | None = None,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    bound: float = 1e-10,
) -> WalkState:
    """The state after ``vertices`` (new rows, or rows in place of those with their
    ids) and edges ``added`` and ``removed``.

    The changes of a step are pushed along the links of the changed vertices only;
    those below ``bound`` divided by the steps, where every vertex starts with 1,
    are let go, so the ranks differ from a full walk by less than ``bound`` in
    all. The links and the kept walk are read, not shuffled, as long as the
    changed vertices of a step are few; a change of most of the network costs
    about what a full walk does. Edges of unknown vertices count for nothing. Runs jobs.
    """
    spark = state.net.vertices.sparkSession
    empty_v, empty_e = (spark.createDataFrame([], s) for s in (VERTICES, EDGES))
    new_v = _few(conform(vertices, VERTICES) if vertices is not None else empty_v)
    plus = _few(canonical_edges(added) if added is not None else empty_e)
    minus = _few(canonical_edges(removed) if removed is not None else empty_e)
    old = state.net
    net = Network(
        cut_lineage(old.vertices.join(new_v.select("id"), "id", "left_anti").unionByName(new_v)),
        cut_lineage(old.edges.join(minus, ["src", "dst"], "left_anti").join(plus, ["src", "dst"], "left_anti").unionByName(plus)),
    )

    # links that come and go: of edges in the changes, and of vertices that (no longer) take part
    was = old.vertices.join(new_v.select("id"), "id", "left_semi").select("id", (F.col("health_status") != RECOVERED).alias("was"))
    now = new_v.select("id", (F.col("health_status") != RECOVERED).alias("now"))
    turned = now.join(was, "id", "left").filter(F.col("now") != F.coalesce("was", F.lit(False))).select("id")
    turned = _few(turned)
    doubtful = _among(net.edges.unionByName(minus), turned, "src", "dst").unionByName(plus).unionByName(minus).distinct()
    doubtful = _few(doubtful.select("src", "dst"))
    after = active_edges(Network(net.vertices, net.edges.join(doubtful, ["src", "dst"], "left_semi")), "both")
    proper = state.links.filter("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    before = proper.join(doubtful, ["src", "dst"], "left_semi")
    moves = cut_lineage(
        after.withColumn("sign", F.lit(1)).unionByName(before.withColumn("sign", F.lit(-1)))
        .groupBy("src", "dst").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    )
    ends = F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))
    moved = moves.select(F.explode(ends).alias("e"), "sign").select("e.i", "e.j", "sign")

    # a vertex is linked if it has a link other than its loop
    known = state.walks.select("id", "weight", "total", "u", "v")
    near = _few(moved.select(F.col("i").alias("id")).distinct())
    degree = (
        state.links.filter("i <> j").join(near.withColumnRenamed("id", "i"), "i", "left_semi").select("i", F.lit(1).alias("sign"))
        .unionByName(moved.select("i", "sign"))
        .groupBy(F.col("i").alias("id")).agg((F.sum("sign") > 0).alias("linked"))
    )
    flips = degree.join(known.select("id", F.lit(True).alias("had")), "id", "left").filter(
        F.col("linked") != F.coalesce("had", F.lit(False))
    )
    loops = flips.select(F.col("id").alias("i"), F.col("id").alias("j"), F.when(F.col("linked"), 1).otherwise(-1).alias("sign"))
    moved = _few(moved.unionByName(loops))
    links = cut_lineage(
        state.links.join(moved.filter("sign < 0").select("i", "j"), ["i", "j"], "left_anti").unionByName(
            moved.filter("sign > 0").select("i", "j")
        )
    )

    # weights and neighbourhood weights, old and new, of all that the changes touch at once
    weight_of = _weighted(Network(new_v, empty_e), state.alpha).withColumnRenamed("weight", "w1")
    weighed = _few(
        known.select("id", F.col("weight").alias("w0")).join(weight_of, "id").filter("w0 <> w1").select("id", "w0", "w1")
    )
    by_weight = state.links.join(weighed.withColumnRenamed("id", "j"), "j").select("i", (F.col("w1") - F.col("w0")).alias("d"))
    # a vertex that has left takes its old weight along
    ends_weight = (
        moved.select(F.col("j").alias("id")).distinct()
        .join(_weighted(net, state.alpha), "id", "left")
        .join(known.select("id", F.col("weight").alias("w0")), "id", "left")
        .select(F.col("id").alias("j"), F.coalesce("weight", "w0").alias("weight"))
    )
    by_links = moved.join(_few(ends_weight), "j").select("i", (F.col("sign") * F.col("weight")).alias("d"))
    totals = by_weight.unionByName(by_links).groupBy(F.col("i").alias("id")).agg(F.sum("d").alias("d"))
    touched = totals.select("id").unionByName(weighed.select("id")).unionByName(moved.select(F.col("i").alias("id"))).distinct()
    members = links.filter("i = j").select(F.col("i").alias("id"), F.lit(True).alias("member"))
    changed = _few(
        touched.join(totals, "id", "left")
        .join(known.select("id", F.col("weight").alias("w0"), F.col("total").alias("t0")), "id", "left")
        .join(_weighted(net, state.alpha).withColumnRenamed("weight", "w1"), "id", "left")
        .join(members, "id", "left")
        .select(
            "id",
            F.coalesce("member", F.lit(False)).alias("member"),
            F.coalesce("w1", "w0").alias("w1"),
            (F.coalesce("t0", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("t1"),
        )
    )
    sizes = _sizes(net, state.alpha, members.join(_weighted(net, state.alpha), "id"))

    # step by step: what each changed vertex passed on, before and now
    low = bound / (2 * state.steps)
    low_v = low * sizes["linked_weight"] / sizes["n_isolated"] if sizes["n_isolated"] else float("inf")
    counts, steps = [], []
    sums = None
    for k in range(state.steps + 1):
        ids = changed.select("id") if sums is None else _few(sums.select("id").unionByName(changed.select("id")).distinct())
        rows = ids.join(_of(known, ids), "id", "left").join(changed, "id", "left")
        if sums is not None:
            rows = rows.join(sums, "id", "left")
        rows = rows.select(
            "id",
            F.col("member").isNotNull().alias("kept"),
            F.coalesce("t1", "total").alias("t1"),
            F.col("total").alias("t0"),
            *_stepped(k, sums is not None),
        )
        small = (F.abs(F.col("u1") - F.col("u0")) <= low) & (F.abs(F.col("v1") - F.col("v0")) <= low_v)
        rows = _few(rows.filter(F.col("kept") | ~small))
        counts.append(rows.count())
        steps.append(rows.select("id", F.lit(k).alias("k"), "u1", "v1"))
        if k == state.steps:
            break
        passed = rows.select(
            F.col("id").alias("i"),
            # what is not in the walk passes nothing on
            *[
                F.coalesce(F.try_divide(F.col(f"{c}{when}"), F.col(f"t{when}")), F.lit(0.0)).alias(f"{c}{when}")
                for c in "uv"
                for when in (0, 1)
            ],
        )
        passed = _few(passed)
        pushed = state.links.join(passed, "i").select("j", *[(F.col(f"{c}1") - F.col(f"{c}0")).alias(c) for c in "uv"])
        at_moves = moved.join(passed, "i").select("j", *[(F.col("sign") * F.col(f"{c}1")).alias(c) for c in "uv"])
        sums = pushed.unionByName(at_moves).groupBy(F.col("j").alias("id")).agg(F.sum("u").alias("du"), F.sum("v").alias("dv"))
        sums = _few(sums)

    every = steps[0]
    for rows in steps[1:]:
        every = every.unionByName(rows)
    patches = every.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct("u1", "v1").alias("x")))).alias("at")
    )
    patches = _few(patches)
    places = F.sequence(F.lit(0), F.lit(state.steps))

    def patched(c: str) -> Column:
        return F.transform(places, lambda k: F.coalesce(F.try_element_at("at", k)[f"{c}1"], F.get(F.col(c), k), F.lit(0.0))).alias(c)

    mended = (
        patches.join(_of(known, patches), "id", "left")
        .join(changed, "id", "left")
        .filter(F.coalesce("member", F.lit(True)))
        .select("id", F.coalesce("w1", "weight").alias("weight"), F.coalesce("t1", "total").alias("total"), patched("u"), patched("v"))
    )
    walks = cut_lineage(known.join(patches.select("id"), "id", "left_anti").unionByName(mended))
    return replace(state, net=net, links=links, walks=walks, touched=tuple(counts), **sizes)


def _of(known: DataFrame, ids: DataFrame) -> DataFrame:
    return known.join(ids.select("id"), "id", "left_semi")


def _stepped(k: int, later: bool) -> list[Column]:
    """Old and new values of both walks after ``k`` steps."""
    gone = ~F.coalesce("member", F.lit(True))
    found = []
    for c in "uv":
        old = F.coalesce(F.get(F.col(c), F.lit(k)), F.lit(0.0))
        if not later:
            new = F.lit(1.0) if c == "u" else F.coalesce("w1", "weight")
        else:
            around = F.coalesce(F.get(F.col(c), F.lit(k)) / F.col("weight"), F.lit(0.0)) + F.coalesce(f"d{c}", F.lit(0.0))
            new = F.coalesce("w1", "weight") * around
        found += [old.alias(f"{c}0"), F.when(gone, F.lit(0.0)).otherwise(new).alias(f"{c}1")]
    return found
