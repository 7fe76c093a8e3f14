"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgraph.functions.ordering import dense_index, sample_k
from contactgraph.operators import blocks, curves, graph, incremental, links, sampling, sparse, stored
from contactgraph.operators.relabel import prune_edges, rank_order, relabel
from contactgraph.schema import INFECTED, RECOVERED, SUSCEPTIBLE, Network
from contactgraph.session import cut_lineage, fresh_folder
from contactgraph.sources import deltas, snapshots, tables

Query = Callable[[SparkSession, str], DataFrame]

ALPHA = -2.0
SEED = 42
# Quotas and samples are one vertex in so many, so they grow with the tables.
INFECTED_IN, RECOVERED_IN = 75, 150
ILL_LABELS_IN, RECOVERED_LABELS_IN = 5, 8
PAIRS_IN = SAMPLE_IN = 15
# Above this many rows the selections count instead of sorting; low, so that
# the counting is what the queries named so run.
COUNTED_ROWS = 8
TOP = 20
# SPARSE_SDF times the number of vertices, so that links grow with vertices
SPARSE_ALPHA, SPARSE_BETA, SPARSE_SDF = 2.0, 5.0, 10
GRID_BETA = [0.3, 0.45, 0.6]
GRID_GAMMA = [0.05, 0.1]
QUOTA_STEP = 5
ROW_BLOCK = 1000
GRID_SIDE = 8
BLOCK_SIDE = 16
CHANGED_IN = 50
LINKS_IN = 5
CUSTOMERS_WITH = 0.25


def _rounded(df: DataFrame, places: int = 9, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


# graph


def active_vertices(spark, sf_dir):
    return graph.active_vertices(tables.customer_vertices(spark, sf_dir))


def active_edges(spark, sf_dir, scope):
    return graph.active_edges(tables.customer_network(spark, sf_dir), scope)


def isolated_vertices(spark, sf_dir, scope):
    return graph.isolated_vertices(tables.customer_network(spark, sf_dir), scope)


def closed_adjacency(spark, sf_dir):
    return graph.closed_adjacency(tables.supplier_network(spark, sf_dir), materialise=True)


def closed_adjacency_real(spark, sf_dir):
    return graph.closed_adjacency(tables.customer_network(spark, sf_dir))


def transition_matrix(spark, sf_dir, source, scope="both", isolated_rows=False):
    matrix = graph.transition_matrix(source(spark, sf_dir), ALPHA, scope, isolated_rows)
    return _rounded(matrix, 9, "value")


def isolated_shares(spark, sf_dir):
    """The one row that all isolated customers have in the transition matrix."""
    shares = graph.isolated_shares(tables.customer_network(spark, sf_dir), ALPHA)
    return _rounded(shares, 12, "share")


def _vector_of_scores(spark, sf_dir):
    well = F.col("score") >= CUSTOMERS_WITH
    return graph.score_vector(tables.customer_vertices(spark, sf_dir), well)[1]


def score_vector(spark, sf_dir):
    vector = _vector_of_scores(spark, sf_dir)
    return vector.df.withColumn("size", F.lit(vector.size).cast("bigint"))


def vector_to_scores(spark, sf_dir):
    halved = sparse.vec_apply(_vector_of_scores(spark, sf_dir), lambda x: x / 2)
    return graph.vector_to_scores(halved)


def walk_rank(spark, sf_dir, steps, scope, source):
    return _rounded(graph.walk_rank(source(spark, sf_dir), ALPHA, steps, scope), 9, "r")


def rescore(spark, sf_dir, steps, scope="both"):
    net = tables.customer_network(spark, sf_dir)
    return _rounded(graph.rescore(net, ALPHA, steps, scope), 9, "score")


def walk_limit(spark, sf_dir, source):
    return _rounded(graph.walk_limit(source(spark, sf_dir), ALPHA), 9, "r")


def walk_updated(spark, sf_dir):
    """Three steps on the customers' network, kept, and then brought up to date after
    some customers recover or change their score, and edges come and go."""
    net = tables.customer_network(spark, sf_dir)
    state = incremental.walk_state(net, ALPHA, steps=3)
    place = F.col("id") % CHANGED_IN
    upserts = net.vertices.filter(place <= 1).select(
        "id",
        F.when(place == 0, 0.0).otherwise(1 - F.col("score") / 2).alias("score"),
        F.when(place == 0, RECOVERED).otherwise(F.col("health_status")).alias("health_status"),
    )
    removed = net.edges.filter((F.col("src") + F.col("dst")) % CHANGED_IN == 2)
    pairs = net.vertices.filter(place == 3).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    added = pairs.join(net.vertices.select(F.col("id").alias("dst")), "dst", "left_semi")
    return _rounded(incremental.update_walk(state, upserts, added, removed).rank(), 9, "r")


def pagerank_equal_scores(spark, sf_dir):
    net = tables.customer_network(spark, sf_dir)
    equal = net.vertices.withColumn("score", F.lit(0.5))
    return _rounded(graph.walk_rank(Network(equal, net.edges), ALPHA, 5), 9, "r")


def top_susceptible(spark, sf_dir):
    """The susceptible customers the walk scores highest."""
    net = tables.customer_network(spark, sf_dir)
    scores = graph.rescore(net, ALPHA, 3)
    susceptible = net.vertices.filter(F.col("health_status") == SUSCEPTIBLE).select("id")
    best = susceptible.join(scores, "id").orderBy(*rank_order()).limit(TOP)
    return _rounded(best, 9, "score")


# relabelling


def _quota(n: int) -> tuple[int, int]:
    return n // INFECTED_IN, n // RECOVERED_IN


def _customer_relabel(spark, sf_dir) -> Network:
    net = tables.customer_network(spark, sf_dir)
    # read by the walk, by the selection and by the removal of edges
    net = Network(net.vertices, cut_lineage(net.edges))
    scores = graph.rescore(net, ALPHA, 3)
    return relabel(net, scores, *_quota(net.vertices.count()), SEED)


def relabel_vertices(spark, sf_dir):
    return _rounded(_customer_relabel(spark, sf_dir).vertices, 9, "score")


def relabel_edges(spark, sf_dir):
    return _customer_relabel(spark, sf_dir).edges


def pruned_edges(spark, sf_dir):
    net = tables.customer_network(spark, sf_dir)
    infected = net.vertices.filter(F.col("health_status") == INFECTED)
    return prune_edges(net.edges, infected)


# sampling


def label_sample(spark, sf_dir, **options):
    ids = tables.customer_vertices(spark, sf_dir).select("id")
    n = ids.count()
    return sampling.label_sample(ids, n // ILL_LABELS_IN, n // RECOVERED_LABELS_IN, SEED, **options)


def sample_customers(spark, sf_dir, **options):
    customers = tables.customer_vertices(spark, sf_dir)
    return sample_k(customers, customers.count() // SAMPLE_IN, SEED, **options).select("id")


def disjoint_pairs(spark, sf_dir):
    ids = tables.customer_vertices(spark, sf_dir).select("id")
    return sampling.disjoint_pairs(ids, ids.count() // PAIRS_IN, SEED)


def _initial_network(spark, sf_dir) -> Network:
    ids = tables.customer_vertices(spark, sf_dir).select("id")
    n = ids.count()
    return sampling.initial_network(
        ids, n // PAIRS_IN, n // ILL_LABELS_IN, n // RECOVERED_LABELS_IN, SEED
    )


def initial_vertices(spark, sf_dir):
    return _initial_network(spark, sf_dir).vertices


def initial_edges(spark, sf_dir):
    return _initial_network(spark, sf_dir).edges


def order_index(spark, sf_dir):
    orders = tables.load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return dense_index(orders, "o_orderdate", "o_orderkey").select("o_orderkey", "idx")


def missing_ranges(spark, sf_dir):
    return links.missing_ranges(tables.customer_network(spark, sf_dir))[0]


def propose_links_skip(spark, sf_dir):
    net = tables.customer_network(spark, sf_dir)
    sdf = float(SPARSE_SDF * net.vertices.count())
    return links.propose_links(net, SPARSE_ALPHA, SPARSE_BETA, sdf, SEED)


def propose_links_chance(spark, sf_dir):
    """The links of ``propose_links_skip`` with the chance that each had."""
    sdf = float(SPARSE_SDF * tables.customer_vertices(spark, sf_dir).count())
    drawn = propose_links_skip(spark, sf_dir)
    return _rounded(links.link_chances(drawn, SPARSE_ALPHA, SPARSE_BETA, sdf, SEED), 9, "chance")


def draw_links(spark, sf_dir):
    """One new link for every so many customers, no more and no fewer."""
    net = tables.customer_network(spark, sf_dir)
    return links.draw_links(net, net.vertices.count() // LINKS_IN, SEED)


# sparse algebra


def vec_repeat(spark, sf_dir):
    customers = tables.load(spark, sf_dir, "customer").count()
    return sparse.vec_repeat(spark, 0.25, customers).df


def vec_apply_exp(spark, sf_dir):
    v = sparse.vec_apply(
        tables.customer_balance(spark, sf_dir), lambda x: F.exp(F.lit(ALPHA) * x / 10)
    )
    return _rounded(v.df, 9, "value")


def _two_vectors(spark, sf_dir, fn, places=6):
    result = fn(tables.filled_orders(spark, sf_dir), tables.urgent_orders(spark, sf_dir))
    return _rounded(result if isinstance(result, DataFrame) else result.df, places, "value")


def vec_outer(spark, sf_dir):
    product = sparse.vec_outer(
        tables.nation_balance(spark, sf_dir), tables.supplier_balance(spark, sf_dir)
    )
    return _rounded(product.df, 3, "value")


def vec_mat(spark, sf_dir):
    product = sparse.vec_mat(
        tables.customer_balance(spark, sf_dir), tables.purchases(spark, sf_dir)
    )
    return _rounded(product.df, 6, "value")


def mat_vec(spark, sf_dir):
    product = sparse.mat_vec(
        tables.purchases(spark, sf_dir), tables.supplier_balance(spark, sf_dir)
    )
    return _rounded(product.df, 6, "value")


def mat_transpose(spark, sf_dir):
    return sparse.mat_transpose(tables.purchases(spark, sf_dir)).df


def mat_mul(spark, sf_dir, **options):
    sold = sparse.mat_transpose(tables.trade(spark, sf_dir, "l_tax"))
    return _rounded(sparse.mat_mul(tables.trade(spark, sf_dir), sold, **options).df, 4, "value")


def mat_mul_blocks(spark, sf_dir):
    sold = sparse.mat_transpose(tables.trade(spark, sf_dir, "l_tax"))
    left, right = (blocks.to_blocks(m, BLOCK_SIDE, coalesced=True) for m in (tables.trade(spark, sf_dir), sold))
    return _rounded(blocks.block_mul(left, right).df, 4, "value")


def block_matrix(spark, sf_dir):
    """The purchases, turned, in blocks and back."""
    laid = blocks.to_blocks(tables.purchases(spark, sf_dir), coalesced=True)
    return blocks.from_blocks(blocks.block_transpose(laid)).df


def vec_dot_exact(spark, sf_dir):
    return sparse.vec_dot(tables.customer_balance(spark, sf_dir), tables.urgent_orders(spark, sf_dir), exact=True)


def vec_mat_exact(spark, sf_dir):
    return sparse.vec_mat(tables.customer_balance(spark, sf_dir), tables.purchases(spark, sf_dir), exact=True).df


def mat_vec_exact(spark, sf_dir):
    return sparse.mat_vec(tables.purchases(spark, sf_dir), tables.supplier_balance(spark, sf_dir), exact=True).df


def _stored_products(spark, sf_dir, key, vector, product):
    """Two products by one stored matrix: with a vector and with its squares."""
    matrix = stored.store(tables.purchases(spark, sf_dir), key)
    v = vector(spark, sf_dir)
    once, squares = product(matrix, v), product(matrix, sparse.vec_apply(v, lambda x: x * x))
    both = once.df.join(squares.df.withColumnRenamed("value", "squares"), "i")
    return _rounded(both, 6, "value", "squares")


def mat_vec_stored(spark, sf_dir):
    return _stored_products(spark, sf_dir, "j", tables.supplier_balance, stored.stored_mat_vec)


def vec_mat_stored(spark, sf_dir):
    return _stored_products(spark, sf_dir, "i", tables.customer_balance, lambda m, v: stored.stored_vec_mat(v, m))


def mat_diag(spark, sf_dir):
    return sparse.mat_diag(tables.customer_balance(spark, sf_dir)).df


def mat_apply(spark, sf_dir):
    halved = sparse.mat_apply(tables.purchases(spark, sf_dir), lambda x: x / 2)
    return halved.df


def mat_scale_cols(spark, sf_dir):
    scaled = sparse.mat_scale_cols(
        tables.purchases(spark, sf_dir), tables.supplier_balance(spark, sf_dir)
    )
    return _rounded(scaled.df, 6, "value")


def mat_scale_rows(spark, sf_dir):
    scaled = sparse.mat_scale_rows(
        tables.customer_balance(spark, sf_dir), tables.purchases(spark, sf_dir)
    )
    return _rounded(scaled.df, 6, "value")


def mat_hadamard(spark, sf_dir):
    product = sparse.mat_hadamard(tables.purchases(spark, sf_dir), tables.returns(spark, sf_dir))
    return product.df


def matrix_rows(spark, sf_dir):
    rows = sparse.matrix_rows(tables.purchases(spark, sf_dir), ROW_BLOCK)
    cell = F.transform(
        "cells", lambda c: F.concat_ws(":", c["j"].cast("string"), c["value"].cast("bigint"))
    )
    return rows.select("i", "block", F.array_join(cell, " ").alias("cells"))


# curves


def _supplier_counts(spark, sf_dir):
    return curves.rounded_counts(tables.supplier_curves(spark, sf_dir))


def rounded_counts(spark, sf_dir):
    counts = _supplier_counts(spark, sf_dir)
    return counts.select("scenario_id", "step", "n_s", "n_i", "n_r")


def _supplier_quotas(spark, sf_dir):
    return curves.step_quotas(_supplier_counts(spark, sf_dir))


def step_quotas(spark, sf_dir):
    return _supplier_quotas(spark, sf_dir)


def _event_quotas(spark, sf_dir):
    return curves.step_quotas(curves.rounded_counts(tables.event_curve(spark, sf_dir)))


def event_quotas(spark, sf_dir):
    return _event_quotas(spark, sf_dir)


def quota_at(spark, sf_dir):
    return curves.quota_at(_supplier_quotas(spark, sf_dir), QUOTA_STEP)


def quota_cursor(spark, sf_dir):
    return curves.quota_cursor(_event_quotas(spark, sf_dir)).na.fill(-1)


def scenario_grid(spark, sf_dir):
    base = tables.supplier_scenarios(spark, sf_dir)
    grid = curves.scenario_grid(base, beta=GRID_BETA, gamma=GRID_GAMMA)
    return _rounded(grid, 9, "i0", "r0")


def peak_infected(spark, sf_dir):
    return curves.peak_infected(tables.supplier_curves(spark, sf_dir))


# snapshots


def _read_back(spark, sf_dir, fmt) -> Network:
    base = fresh_folder(spark, "snapshots")
    snapshots.write_snapshot(tables.customer_network(spark, sf_dir), base, 0, fmt)
    return snapshots.read_snapshot(spark, base, 0, fmt)


def snapshot_vertices(spark, sf_dir):
    return _read_back(spark, sf_dir, "parquet").vertices


def snapshot_edges_csv(spark, sf_dir):
    return _read_back(spark, sf_dir, "csv").edges


def observed_curve(spark, sf_dir):
    """A snapshot for every month of orders, written at once and read back."""
    base = fresh_folder(spark, "history")
    snapshots.write_history(tables.monthly_vertices(spark, sf_dir), tables.monthly_edges(spark, sf_dir), base)
    return curves.observed_curve(snapshots.read_history(spark, base)[0])


def _kept_steps(spark, sf_dir) -> str:
    """Three steps of the customers' network, the first whole: some recover, change
    their score, lose and get edges; then some leave."""
    base = fresh_folder(spark, "deltas")
    net = tables.customer_network(spark, sf_dir)
    deltas.write_step(net, base, 0)
    place = F.col("id") % CHANGED_IN
    vertices = net.vertices.withColumns(
        {
            "score": F.when(place == 0, 0.0).when(place == 1, 1 - F.col("score") / 2).otherwise(F.col("score")),
            "health_status": F.when(place == 0, RECOVERED).otherwise(F.col("health_status")),
        }
    )
    pairs = net.vertices.filter(place == 3).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    added = pairs.join(net.vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    kept = net.edges.filter((F.col("src") + F.col("dst")) % CHANGED_IN != 2)
    edges = kept.unionByName(added).distinct()
    deltas.write_step(Network(vertices, edges), base, 1, parent=0)
    stays = [F.col(end) % CHANGED_IN != 4 for end in ("id", "src", "dst")]
    deltas.write_step(Network(vertices.filter(stays[0]), edges.filter(stays[1] & stays[2])), base, 2, parent=1)
    return base


def delta_vertices(spark, sf_dir):
    return deltas.read_step(spark, _kept_steps(spark, sf_dir), 2).vertices


def delta_edges(spark, sf_dir):
    return deltas.read_step(spark, _kept_steps(spark, sf_dir), 2).edges


def delta_counts(spark, sf_dir):
    return deltas.kept_counts(spark, _kept_steps(spark, sf_dir))


def _foreign(spark, sf_dir) -> Network:
    """Headerless CSV as others write it: the status as 1.0, edges in any order and twice."""
    base = fresh_folder(spark, "foreign")
    net = tables.customer_network(spark, sf_dir)
    status = F.col("health_status").cast("double")
    net.vertices.withColumn("health_status", status).write.csv(f"{base}/v")
    turned = net.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    net.edges.unionByName(turned).write.csv(f"{base}/e")
    return snapshots.read_tables(spark, f"{base}/v", f"{base}/e")


def foreign_csv_vertices(spark, sf_dir):
    return _foreign(spark, sf_dir).vertices


def foreign_csv_edges(spark, sf_dir):
    return _foreign(spark, sf_dir).edges


def queries() -> dict[str, Query]:
    two = partial(partial, _two_vectors)
    return {
        "top_susceptible": top_susceptible,
        "active_vertices": active_vertices,
        "active_edges_both": partial(active_edges, scope="both"),
        "active_edges_either": partial(active_edges, scope="either"),
        "isolated_vertices": partial(isolated_vertices, scope="both"),
        "isolated_vertices_either": partial(isolated_vertices, scope="either"),
        "closed_adjacency": closed_adjacency,
        "closed_adjacency_real": closed_adjacency_real,
        "transition_matrix": partial(transition_matrix, source=tables.customer_network),
        "transition_matrix_either": partial(
            transition_matrix, source=tables.customer_network, scope="either"
        ),
        "transition_matrix_suppliers": partial(
            transition_matrix, source=tables.supplier_network, isolated_rows=True
        ),
        "isolated_shares": isolated_shares,
        "score_vector": score_vector,
        "vector_to_scores": vector_to_scores,
        "walk_rank_3": partial(
            walk_rank, steps=3, scope="both", source=tables.customer_network
        ),
        "walk_rank_10": partial(
            walk_rank, steps=10, scope="both", source=tables.customer_network
        ),
        "walk_rank_either": partial(
            walk_rank, steps=3, scope="either", source=tables.customer_network
        ),
        "walk_rank_suppliers": partial(
            walk_rank, steps=3, scope="both", source=tables.supplier_network
        ),
        "walk_rank_users": partial(walk_rank, steps=3, scope="both", source=tables.user_network),
        "walk_limit": partial(walk_limit, source=tables.customer_network),
        "walk_limit_suppliers": partial(walk_limit, source=tables.supplier_network),
        "walk_updated": walk_updated,
        "rescore_3": partial(rescore, steps=3),
        "rescore_either": partial(rescore, steps=3, scope="either"),
        "pagerank_equal_scores": pagerank_equal_scores,
        "relabel_topk": relabel_vertices,
        "relabel_edges": relabel_edges,
        "prune_edges": pruned_edges,
        "label_sample": label_sample,
        "label_sample_counted": partial(label_sample, top_rows=COUNTED_ROWS),
        "sample_k": sample_customers,
        "sample_k_counted": partial(sample_customers, top_rows=COUNTED_ROWS),
        "disjoint_pairs": disjoint_pairs,
        "dense_index": order_index,
        "initial_vertices": initial_vertices,
        "initial_edges": initial_edges,
        "missing_ranges": missing_ranges,
        "propose_links_skip": propose_links_skip,
        "propose_links_chance": propose_links_chance,
        "draw_links": draw_links,
        "vec_repeat": vec_repeat,
        "vec_apply_exp": vec_apply_exp,
        "vec_dot": two(fn=sparse.vec_dot, places=6),
        "vec_add": two(fn=sparse.vec_add),
        "vec_sub": two(fn=sparse.vec_sub),
        "vec_hadamard": two(fn=sparse.vec_hadamard),
        "vec_outer": vec_outer,
        "vec_mat": vec_mat,
        "mat_vec": mat_vec,
        "mat_transpose": mat_transpose,
        "mat_mul": mat_mul,
        "mat_mul_grid": partial(mat_mul, side=GRID_SIDE),
        "mat_mul_blocks": mat_mul_blocks,
        "block_matrix": block_matrix,
        "vec_dot_exact": vec_dot_exact,
        "vec_mat_exact": vec_mat_exact,
        "mat_vec_exact": mat_vec_exact,
        "mat_vec_stored": mat_vec_stored,
        "vec_mat_stored": vec_mat_stored,
        "mat_diag": mat_diag,
        "mat_apply": mat_apply,
        "mat_scale_cols": mat_scale_cols,
        "mat_scale_rows": mat_scale_rows,
        "mat_hadamard": mat_hadamard,
        "matrix_rows": matrix_rows,
        "rounded_counts": rounded_counts,
        "step_quotas": step_quotas,
        "event_quotas": event_quotas,
        "quota_at": quota_at,
        "quota_cursor": quota_cursor,
        "scenario_grid": scenario_grid,
        "peak_infected": peak_infected,
        "snapshot_vertices": snapshot_vertices,
        "snapshot_edges_csv": snapshot_edges_csv,
        "observed_curve": observed_curve,
        "delta_vertices": delta_vertices,
        "delta_edges": delta_edges,
        "delta_counts": delta_counts,
        "foreign_csv_vertices": foreign_csv_vertices,
        "foreign_csv_edges": foreign_csv_edges,
    }
