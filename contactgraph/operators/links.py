"""Vertex pairs without an edge, and sampling of new edges among them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgraph.functions.draws import beta_draw
from contactgraph.functions.hashing import portable_uniform, uniform_text
from contactgraph.functions.joins import hot_join
from contactgraph.functions.ordering import dense_index, first_k, sum_before, with_next
from contactgraph.schema import EDGES, Network, conform
from contactgraph.session import cut_lineage, partition_count, spread

_PIECE = 1_024  # numbers per array
# Ranges are not longer than 2**40; at lower rates there are more ranges than
# links, which changes the work and not the law.
_MAX_LEVELS = 40
_UNIFORM_BITS = 52  # of one uniform; longer numbers are drawn in two parts
_LOW_BITS = 20


def _eligible_ids(net: Network, eligible: Column | None) -> DataFrame:
    vertices = net.vertices if eligible is None else net.vertices.filter(eligible)
    return vertices.select("id")


def missing_ranges(net: Network, eligible: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(src, first, last)`` and ``(id, idx)``: for each source the ranges of
    later numbers ``idx`` that hold no neighbour of it.

    (Eligible) vertices are numbered from 1 by id. There are at most as many
    ranges as vertices and edges together. Each vertex stands before its later
    neighbours as a neighbour of itself, all are put in order once, and what lies
    between one and the next is a range; so the neighbours of a hub are spread
    like others. Runs jobs.
    """
    ids = cut_lineage(dense_index(_eligible_ids(net, eligible), "id"))
    n = ids.count()
    by_src = hot_join(net.edges, ids.select(F.col("id").alias("src"), F.col("idx").alias("s")), "src")
    by_both = hot_join(by_src, ids.select(F.col("id").alias("dst"), F.col("idx").alias("t")), "dst")
    own = ids.select(F.col("id").alias("src"), F.col("idx").alias("s"), F.col("idx").alias("t"))
    ordered = by_both.select("src", "s", "t").unionByName(own)
    after = with_next(ordered, ["s", "t"], ["s", "t"])
    last = F.when(F.col("next_s") == F.col("s"), F.col("next_t") - 1).otherwise(F.lit(n))
    ranges = after.select("src", (F.col("t") + 1).alias("first"), last.alias("last"))
    return ranges.filter("first <= last"), ids


def missing_pairs(net: Network, eligible: Column | None = None) -> DataFrame:
    """All pairs ``src < dst`` of (eligible) vertices that have no edge: the
    ranges of :func:`missing_ranges`, spelled out in pieces of 1,024. The answer
    has about n*n/2 rows, so it is for small vertex sets."""
    ranges, ids = missing_ranges(net, eligible)
    pieces = ranges.select(
        "src", "last", F.explode(F.sequence("first", "last", F.lit(_PIECE).cast("long"))).alias("lo")
    )
    numbers = F.sequence("lo", F.least("last", F.col("lo") + (_PIECE - 1)))
    pairs = spread(pieces, "src", "lo").select("src", F.explode(numbers).alias("idx"))
    return conform(pairs.join(ids.withColumnRenamed("id", "dst"), "idx"), EDGES)


def link_rate(alpha: float, beta: float, sdf: float) -> float:
    """Chance of a new edge. A fresh Beta(alpha, beta + sdf) chance per pair and
    one draw from it is a Bernoulli draw with the Beta mean."""
    if alpha <= 0 or beta + sdf <= 0:
        raise ValueError("alpha and beta + sdf must be positive")
    return alpha / (alpha + beta + sdf)


def skip_levels(rate: float) -> int:
    """Number of halvings of a target range holding about one link."""
    return max(0, min(_MAX_LEVELS, math.ceil(math.log2(1.0 / rate))))


def _sampled_ranks(ids: DataFrame, n: int, rate: float, seed) -> DataFrame:
    """Independent draws over all index pairs, as (src, t), t the target index.

    Every source's later targets are cut into ranges of 2**levels. A range is
    kept with the chance that it holds a link at all, then halved ``levels``
    times; which halves stay is drawn given that the range holds one. Ranges of
    length one are the links. Work follows the number of links, not of pairs,
    and there is no shuffle.
    """
    levels = skip_levels(rate)
    span = 2**levels

    def hit(length: str) -> str:
        return f"(-expm1({length} * {math.log1p(-rate)!r}D))"

    # in two levels, so that no row holds more than n / (1024 span) numbers
    wide = span * _PIECE
    ranges = (
        ids.filter(F.col("idx") < n)
        .selectExpr("id src", f"explode(sequence(idx + 1, {n}L, {wide}L)) far")
        .selectExpr("src", f"explode(sequence(far, least({n}L, far + {wide - span}L), {span}L)) lo")
    )
    roots = ranges.selectExpr("src", "lo", f"least({span}L, {n}L - lo + 1) len")
    chance = f"{uniform_text(seed, chr(39) + 'root' + chr(39), 'src', 'lo')} < {hit('len')}"
    nodes = roots.selectExpr("src", f"named_struct('keep', {chance}, 'lo', lo, 'len', len) node")
    for level in range(levels, 0, -1):
        nodes = (
            nodes.filter("node.keep")
            .selectExpr(
                "src",
                "node.lo lo",
                "node.len len",
                f"least({2 ** (level - 1)}L, len) l",
                "len - l r",
                f"{uniform_text(seed, str(level), 'src', 'lo')} u",
                f"{hit('l')} * (1 - {hit('r')}) / {hit('len')} only_left",
                f"{hit('r')} * (1 - {hit('l')}) / {hit('len')} only_right",
            )
            .selectExpr(
                "src",
                """explode(array(
                     named_struct('keep', r = 0 or u < only_left or u >= only_left + only_right,
                                  'lo', lo, 'len', l),
                     named_struct('keep', r > 0 and u >= only_left,
                                  'lo', lo + l, 'len', r))) node""",
            )
        )
    return nodes.filter("node.keep").selectExpr("src", "node.lo t")


def propose_links(
    net: Network,
    alpha: float,
    beta: float,
    sdf: float,
    seed,
    eligible: Column | None = None,
) -> DataFrame:
    """New edges, each missing pair drawn on its own at :func:`link_rate`.

    Work is in proportion to the links drawn. Recovered vertices take part
    unless ``eligible`` says otherwise. The caller unions with the old edges.
    Runs jobs to number the vertices.
    """
    rate = link_rate(alpha, beta, sdf)
    if rate >= 1.0:
        raise ValueError("the rate rounds to 1: beta + sdf is too small beside alpha")
    ids = dense_index(_eligible_ids(net, eligible), "id")
    n = ids.count()
    drawn = _sampled_ranks(spread(ids, "id", rows=int(rate * n * (n - 1) / 2)), n, rate, seed)
    pairs = drawn.join(ids.select(F.col("id").alias("dst"), F.col("idx").alias("t")), "t")
    return conform(pairs, EDGES).join(net.edges, ["src", "dst"], "left_anti")


def link_chances(links: DataFrame, alpha: float, beta: float, sdf: float, seed) -> DataFrame:
    """Add ``chance``: the Beta(alpha, beta + sdf) chance that each drawn link had.

    Given that a pair became a link, its chance is Beta(alpha + 1, beta + sdf), so
    links of :func:`propose_links` with these chances have the law of drawing a
    chance for every pair and then the link, without a row for the other pairs.
    """
    link_rate(alpha, beta, sdf)
    return links.withColumn("chance", beta_draw(alpha + 1, beta + sdf, seed, "src", "dst"))


def _numbers_below(total: int, seed, key: str) -> Column:
    """Whole numbers drawn for each ``key``; some may be ``total`` or more, where
    the caller drops the draw."""
    low = 1 if total <= 2**_UNIFORM_BITS else 2**_LOW_BITS
    high = F.floor(portable_uniform(seed, F.lit("high"), key) * F.lit(float(-(-total // low)))).cast("long")
    if low == 1:
        return high
    return high * low + F.floor(portable_uniform(seed, F.lit("low"), key) * F.lit(float(low))).cast("long")


def _distinct_numbers(spark, k: int, total: int, seed) -> DataFrame:
    """``(pos)``: k different numbers below ``total``, every set of k equally
    likely: the first k different ones of a sequence of draws. Meant for k of at
    most half of ``total``, where k numbers take less than 1.4 k draws."""
    expected = -total * math.log1p(-k / total)
    draws = math.ceil(expected + 6 * math.sqrt(expected)) + 16
    while True:
        drawn = spark.range(0, draws, 1, partition_count(spark, draws))
        drawn = drawn.select("id", _numbers_below(total, seed, "id").alias("pos")).filter(F.col("pos") < total)
        firsts = cut_lineage(drawn.groupBy("pos").agg(F.min("id").alias("draw")))
        if firsts.count() >= k:
            return first_k(firsts, k, "draw").select("pos")
        draws *= 2  # the draws so far stay the first ones


def draw_links(net: Network, m: int, seed, eligible: Column | None = None) -> DataFrame:
    """Exactly ``m`` new edges (all missing pairs, if fewer), every set of m
    missing pairs of (eligible) vertices equally likely.

    Missing pairs are numbered through by the lengths of :func:`missing_ranges`;
    m different numbers are drawn and looked up. Numbers are cut into as many
    equal blocks as there are ranges or draws, ranges are listed under the blocks
    they touch, and both meet by block, so work follows vertices, edges and m. For
    more than half of all pairs those to leave out are drawn instead and the others
    spelled out, fewer than 2 m rows. Runs jobs.
    """
    if m < 0:
        raise ValueError(f"m must not be negative, got {m}")
    spark = net.vertices.sparkSession
    ranges, ids = missing_ranges(net, eligible)
    sized = ranges.withColumn("len", F.col("last") - F.col("first") + 1)
    placed = sum_before(sized, ["src", "first"], "len", "start")
    count, total = placed.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    m = min(m, total)
    if m == 0:
        return net.edges.limit(0)
    if 2 * m <= total:
        numbers = _distinct_numbers(spark, m, total, seed)
        width = -(-total // max(count, m))
        touched = F.sequence(F.expr(f"start div {width}L"), F.expr(f"(start + len - 1) div {width}L"))
        listed = placed.select("src", "first", "start", "len", F.explode(touched).alias("block"))
        inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("len"))
        found = numbers.withColumn("block", F.expr(f"pos div {width}L")).join(listed, "block").filter(inside)
    else:
        pieces = placed.select(
            "src",
            "first",
            "start",
            F.expr("start + len - 1").alias("end"),
            F.explode(F.expr(f"sequence(start, start + len - 1, {_PIECE}L)")).alias("lo"),
        )
        spelled = F.sequence("lo", F.least("end", F.col("lo") + (_PIECE - 1)))
        found = spread(pieces, "src", "lo", rows=total).select("src", "first", "start", F.explode(spelled).alias("pos"))
        if m < total:
            left_out = _distinct_numbers(spark, total - m, total, seed)
            found = found.join(left_out, "pos", "left_anti")
    ranks = found.select("src", (F.col("first") + F.col("pos") - F.col("start")).alias("idx"))
    return conform(ranks.join(ids.withColumnRenamed("id", "dst"), "idx"), EDGES)
