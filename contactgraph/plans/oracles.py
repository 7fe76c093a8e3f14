"""DuckDB SQL giving the same rows as the registered queries, written from the
definitions (dense adjacency, full pair lists, plain sorts)."""

from __future__ import annotations

from contactgraph.plans.catalog import (
    ALPHA,
    CHANGED_IN,
    CUSTOMERS_WITH,
    GRID_BETA,
    GRID_GAMMA,
    ILL_LABELS_IN,
    INFECTED_IN,
    LINKS_IN,
    PAIRS_IN,
    QUOTA_STEP,
    RECOVERED_IN,
    RECOVERED_LABELS_IN,
    ROW_BLOCK,
    SAMPLE_IN,
    SEED,
    SPARSE_ALPHA,
    SPARSE_BETA,
    SPARSE_SDF,
    TOP,
)

Ctes = list[tuple[str, str]]


def _with(ctes: Ctes, final: str, recursive: bool = False) -> str:
    body = ",\n".join(f"{name} as ({sql})" for name, sql in ctes)
    return f"with {'recursive ' if recursive else ''}{body}\n{final}"


def _uniform(seed, *parts: str) -> str:
    text = ", ".join([f"'{seed}'", *parts])
    return (
        f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::bigint"
        f" / cast(4503599627370496 as double))"
    )


def _double(x: float) -> str:
    return f"cast('{x!r}' as double)"


# networks as CTEs v(id, score, health_status) and e(src, dst)

_CUSTOMER_V = """
select c_custkey id,
  case when c_mktsegment = 'MACHINERY' then cast(0 as double)
       when c_mktsegment = 'BUILDING' then cast(1 as double)
       else greatest(cast(0 as double), least(cast(1 as double), c_acctbal / 10000)) end score,
  cast(case when c_mktsegment = 'MACHINERY' then -1 when c_mktsegment = 'BUILDING' then 1
       else 0 end as integer) health_status
from customer"""

_CUSTOMER_E = """
select distinct least(a, b) src, greatest(a, b) dst from (
  select o_custkey a, o_orderdate d, o_orderpriority p, lead(o_custkey) over w b,
    lead(o_orderdate) over w d2, lead(o_orderpriority) over w p2
  from orders window w as (order by o_orderdate, o_orderkey))
where a <> b and d = d2 and p = p2"""

_SUPPLIER_V = """
select s_suppkey id,
  greatest(cast(0 as double), least(cast(1 as double), s_acctbal / 10000)) score,
  cast(0 as integer) health_status
from supplier"""

_SUPPLIER_E = """
select distinct least(a, b) src, greatest(a, b) dst from (
  select s_suppkey a, s_acctbal x, lead(s_suppkey) over w b, lead(s_acctbal) over w y
  from supplier window w as (partition by s_nationkey order by s_acctbal, s_suppkey))
where a <> b and y - x < 500"""

_USER_V = """
select user_id id,
  case when 4 * errors >= total then cast(1 as double)
       when 20 * errors <= 3 * total then cast(0 as double)
       else cast(errors as double) / total end score,
  cast(case when 4 * errors >= total then 1 when 20 * errors <= 3 * total then -1
       else 0 end as integer) health_status
from (select user_id, count(*) filter (event_type = 'error') errors, count(*) total
      from events group by user_id)"""

_USER_E = """
select distinct least(a, b) src, greatest(a, b) dst from (
  select user_id a, ts t, lead(user_id) over w b, lead(ts) over w t2
  from events window w as (partition by event_type order by ts, event_id))
where a <> b and t2 - t <= interval 10 minute"""

CUSTOMERS: Ctes = [("v", _CUSTOMER_V), ("e", _CUSTOMER_E)]
SUPPLIERS: Ctes = [("v", _SUPPLIER_V), ("e", _SUPPLIER_E)]
USERS: Ctes = [("v", _USER_V), ("e", _USER_E)]

_ACTIVE: Ctes = [
    ("act", "select * from v where health_status <> -1"),
    (
        "e_both",
        "select src, dst from e where src in (select id from act)"
        " and dst in (select id from act)",
    ),
    (
        "e_either",
        "select src, dst from e where src in (select id from act)"
        " or dst in (select id from act)",
    ),
]


def _isolated(scope: str) -> Ctes:
    return [
        (
            "iso",
            f"select * from act where id not in (select src from e_{scope})"
            f" and id not in (select dst from e_{scope})",
        )
    ]


_LINKS: Ctes = [
    (
        "adj",
        "select src i, dst j from e_both union all select dst, src from e_both"
        " union all select id, id from act where id not in (select id from iso)",
    )
]

_ADJACENCY: Ctes = [
    (
        "adj",
        "select src i, dst j from e_both union all select dst, src from e_both"
        " union all select id, id from act"
        " union all select iso.id, act.id from iso, act where iso.id <> act.id",
    )
]


def _transition(weight: str = f"exp(({ALPHA}) * score)") -> Ctes:
    return [
        ("w", f"select id, {weight} w from act"),
        ("b", "select i, sum(w) b from adj join w on j = id group by i"),
        ("p", "select adj.i, j, w / b p from adj join w on j = id join b on b.i = adj.i"),
    ]


def _walk(steps: int) -> Ctes:
    ctes = [("r0", "select id, cast(1 as double) / (select count(*) from act) r from act")]
    for k in range(1, steps + 1):
        ctes.append(
            (f"r{k}", f"select j id, sum(r * p) r from r{k - 1} join p on id = i group by j")
        )
    return ctes


# the limit of the walk: within a component in proportion to weight times neighbourhood weight
_LIMIT: Ctes = [
    ("w", f"select id, exp(({ALPHA}) * score) w from act"),
    ("reach", "select i, j from adj union select r.i, a.j from reach r join adj a on a.i = r.j"),
    ("comp", "select i id, min(j) c from reach group by i"),
    ("pull", "select adj.i id, any_value(x.w) w, any_value(x.w) * sum(y.w) pull from adj join w x on x.id = adj.i"
     " join w y on y.id = adj.j group by adj.i"),
    ("gone", "select count(*) / cast((select count(*) from act) as double) share from iso"),
    ("held", "select c, sum(pull) pulls, count(*) / cast((select count(*) from act) as double)"
     " + sum(w) / (select sum(w) from pull) * (select share from gone) held from comp join pull using (id) group by c"),
]
_LIMIT_RANK = (
    "select id, round(held * pull / pulls, 9) r from comp join pull using (id) join held using (c)"
    # those who start isolated leave in the end, unless everyone is isolated
    " union all select id, case when exists (from comp) then 0 else round(w / (select sum(w) from w), 9) end"
    " from iso join w using (id)"
)

# the customers' network after the changes of walk_updated
_CHANGED: Ctes = [
    ("v0", _CUSTOMER_V),
    ("e0", _CUSTOMER_E),
    (
        "v",
        f"select id, case when id % {CHANGED_IN} = 0 then cast(0 as double) when id % {CHANGED_IN} = 1 then 1 - score / 2"
        f" else score end score, cast(case when id % {CHANGED_IN} = 0 then -1 else health_status end as integer) health_status from v0",
    ),
    (
        "e",
        f"select src, dst from e0 where (src + dst) % {CHANGED_IN} <> 2"
        f" union select a.id, b.id from v0 a join v0 b on b.id = a.id + 1 where a.id % {CHANGED_IN} = 3",
    ),
]


def _scores(net: Ctes, steps: int, scope: str = "both") -> Ctes:
    return [
        *net,
        *_ACTIVE,
        *_isolated(scope),
        *_ADJACENCY,
        *_transition(),
        *_walk(steps),
        (
            "scores",
            f"select act.id, score + (1 - score) * r score from act join r{steps} using (id)",
        ),
    ]


def _relabel(v: str, scores: str, k_i: str, k_r: str, seed, out: str) -> Ctes:
    """CTEs ``<out>(id, score, health_status, recovers)``."""
    return [
        (
            f"{out}_rows",
            f"select {v}.id, {v}.score, health_status, {scores}.score new_score"
            f" from {v} left join {scores} on {scores}.id = {v}.id",
        ),
        (
            f"{out}_ill",
            f"select id from (select id, row_number() over"
            f" (order by round(new_score, 12) desc, id) n from {out}_rows"
            f" where health_status = 0 and new_score is not null) where n <= {k_i}",
        ),
        (
            f"{out}_rec",
            f"select id from (select id, row_number() over"
            f" (order by {_uniform(seed, chr(39) + 'recover' + chr(39), 'id')}, id) n"
            f" from {out}_rows where health_status = 1 and new_score is not null)"
            f" where n <= {k_r}",
        ),
        (
            out,
            f"select id, case when id in (select id from {out}_ill) then cast(1 as double)"
            f" when id in (select id from {out}_rec) then cast(0 as double)"
            f" else coalesce(new_score, score) end score,"
            f" cast(case when id in (select id from {out}_ill) then 1"
            f" when id in (select id from {out}_rec) then -1 else health_status end as integer)"
            f" health_status from {out}_rows",
        ),
    ]


def _pruned(e: str, recovered: str) -> str:
    return (
        f"select src, dst from {e} where src not in (select id from {recovered})"
        f" and dst not in (select id from {recovered})"
    )


def _part(share: int) -> str:
    return f"(select count(*) // {share} from v)"


def _first_in_hash_order(source: str, k: str, *salt: str, where: str = "true") -> str:
    u = _uniform(SEED, *salt, "id")
    return (
        f"select id, n from (select id, row_number() over (order by {u}, id) n"
        f" from {source} where {where}) where n <= {k}"
    )


def _skip_links(v: str, e: str, seed) -> tuple[Ctes, str]:
    """CTEs and the query for links drawn by halving ranges, see propose_links."""
    alpha, beta, per_vertex = _double(SPARSE_ALPHA), _double(SPARSE_BETA), SPARSE_SDF

    def hit(length: str) -> str:
        return f"(1 - exp({length} * c))"

    root = _uniform(seed, "'root'", "src", "lo")
    split = _uniform(seed, "lvl", "src", "lo")
    only_left = f"{hit('l')} * (1 - {hit('r')}) / {hit('len')}"
    only_right = f"{hit('r')} * (1 - {hit('l')}) / {hit('len')}"
    ctes: Ctes = [
        ("ids", f"select id, row_number() over (order by id) idx from {v}"),
        (
            "rate",
            f"select n, {alpha} / ({alpha} + {beta} + {per_vertex} * n) rate"
            f" from (select count(*) n from {v})",
        ),
        (
            "par",
            "select n, ln(1 - rate) c, cast(ceil(log2(1 / rate)) as integer) levels,"
            " 1 << cast(ceil(log2(1 / rate)) as integer) span from rate",
        ),
        (
            "roots",
            "select src, lo, least(span, n - lo + 1) len, c, levels from"
            " (select id src, unnest(range(idx + 1, n + 1, span)) lo, n, c, levels, span"
            " from ids, par)",
        ),
        (
            "nodes",
            f"select levels lvl, src, lo, len, c from roots where {root} < {hit('len')}"
            f" union all select lvl - 1, src, case when side = 0 then lo else lo + l end,"
            f" case when side = 0 then l else r end, c"
            f" from (select *, {only_left} ol, {only_right} orr, {split} u from"
            f"  (select *, least(len, 1 << (lvl - 1)) l, len - least(len, 1 << (lvl - 1)) r"
            f"   from nodes where lvl > 0)), (values (0), (1)) s(side)"
            f" where (side = 0 and (r = 0 or u < ol or u >= ol + orr))"
            f" or (side = 1 and r > 0 and u >= ol)",
        ),
    ]
    return ctes, (
        f"select nodes.src, ids.id dst from nodes join ids on idx = lo where lvl = 0"
        f" and not exists (select 1 from {e} x where x.src = nodes.src and x.dst = ids.id)"
    )


_RANGES: Ctes = [
    ("ids", "select id, row_number() over (order by id) idx from v"),
    (
        "marks",
        "select id, idx s, idx t from ids union all select a.id, a.idx, b.idx"
        " from e join ids a on a.id = src join ids b on b.id = dst",
    ),
    (
        "gaps",
        "select id src, t + 1 first, coalesce(lead(t) over (partition by s order by t) - 1,"
        " (select count(*) from ids)) last from marks",
    ),
]


def _drawn_numbers(m: str) -> Ctes:
    """CTEs for the missing pairs numbered through and the first m different numbers drawn."""
    number = f"cast(floor({_uniform(SEED, chr(39) + 'high' + chr(39), 'k')} * total) as bigint)"
    return [
        (
            "placed",
            "select src, first, last - first + 1 len, sum(last - first + 1) over (order by src, first)"
            " - (last - first + 1) start from gaps where first <= last",
        ),
        ("size", "select sum(len) total from placed"),
        ("draws", f"select k, {number} pos from (select unnest(range(4 * {m} + 64)) k), size"),
        ("numbers", f"select pos from draws group by pos order by min(k) limit {m}"),
    ]


_NUMBERED_LINKS = (
    "select src, id dst from numbers join placed on pos >= start and pos < start + len"
    " join ids on idx = first + pos - start"
)


def _chances(links: str, seed) -> Ctes:
    """CTEs for a Beta(alpha + 1, beta + sdf) chance of each link, see log_gamma_text."""
    u = {t: f"(1 - {_uniform(seed, chr(39) + t + chr(39), 'tag', 'src', 'dst', 'k')})" for t in ("r", "angle", "accept")}
    return [
        ("links", links),
        (
            "shapes",
            f"select 'a' tag, {_double(SPARSE_ALPHA + 1)} - cast(1 as double) / 3 d"
            f" union all select 'b', {_double(SPARSE_BETA)} + {SPARSE_SDF} * n - cast(1 as double) / 3 from rate",
        ),
        (
            "tries",
            f"select *, sqrt(-2 * ln({u['r']})) * cos(2 * pi() * {u['angle']}) x, ln({u['accept']}) l"
            f" from links, shapes, (select unnest(range(32)) k)",
        ),
        ("cubed", "select *, power(1 + x / sqrt(9 * d), 3) v from tries"),
        (
            "gammas",
            "select src, dst, tag, any_value(d) * arg_min(v, k) g from cubed"
            " where l < case when v > 0 then x * x / 2 + d * (1 - v + ln(v)) end group by src, dst, tag",
        ),
    ]


_CHANCES = (
    "select a.src, a.dst, round(a.g / (a.g + b.g), 9) chance from gammas a"
    " join gammas b on a.src = b.src and a.dst = b.dst where a.tag = 'a' and b.tag = 'b'"
)


# curves

_SUPPLIER_SCENARIOS: Ctes = [
    ("v", _CUSTOMER_V),
    (
        "served",
        "select distinct l_suppkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey",
    ),
    (
        "scen",
        "select l_suppkey scenario_id,"
        " cast(0.35 as double) + cast(0.05 as double) * any_value(n_regionkey) beta,"
        " cast(0.05 as double) gamma, count(*) n,"
        " cast(count(*) filter (health_status = 1) as double) / count(*) i0,"
        " cast(count(*) filter (health_status = -1) as double) / count(*) r0"
        " from served join v on o_custkey = id join supplier on s_suppkey = l_suppkey"
        " join nation on s_nationkey = n_nationkey group by l_suppkey",
    ),
]

_GRID: Ctes = [
    (
        "grid",
        f"select cast(scenario_id * {len(GRID_BETA) * len(GRID_GAMMA)}"
        f" + (bi - 1) * {len(GRID_GAMMA)} + gi - 1 as bigint) scenario_id,"
        f" cast(b as double) beta, cast(g as double) gamma, n, i0, r0 from scen,"
        f" (select unnest({GRID_BETA}) b, unnest(range(1, {len(GRID_BETA) + 1})) bi),"
        f" (select unnest({GRID_GAMMA}) g, unnest(range(1, {len(GRID_GAMMA) + 1})) gi)",
    )
]


_SUPPLIER_CURVES: Ctes = [
    (
        "lines",
        "select l_suppkey, l_returnflag, cast(date_diff('month', (select min(l_shipdate) from lineitem),"
        " l_shipdate) as integer) step from lineitem",
    ),
    (
        "curve",
        "select l_suppkey scenario_id, step,"
        " cast(count(*) filter (l_returnflag = 'N') as double) / count(*) s,"
        " cast(count(*) filter (l_returnflag = 'R') as double) / count(*) i,"
        " cast(count(*) filter (l_returnflag = 'A') as double) / count(*) r,"
        " cast(sum(count(*)) over (partition by l_suppkey) as bigint) n from lines group by 1, 2",
    ),
]


_COUNTS: Ctes = [
    (
        "counts",
        "select *, "
        + ", ".join(
            f"cast(round_even(round(n * {c}, 9), 0) as bigint) n_{c}" for c in ("s", "i", "r")
        )
        + " from curve",
    )
]


def _change(col: str) -> str:
    return (
        f"cast(greatest({col} - lag({col}, 1, 0) over"
        f" (partition by scenario_id order by step), 0) as integer)"
    )


_QUOTAS: Ctes = [
    (
        "quotas",
        f"select scenario_id, step, {_change('n_i')} new_infected,"
        f" {_change('n_r')} new_recovered from counts",
    )
]

_EVENT_CURVE: Ctes = [
    (
        "curve",
        "select cast(0 as bigint) scenario_id, cast(date_diff('day', (select min(ts) from events), ts) as integer) step,"
        " cast(count(*) filter (event_type in ('view', 'click', 'signup')) as double)"
        " / count(*) s,"
        " cast(count(*) filter (event_type = 'error') as double) / count(*) i,"
        " cast(count(*) filter (event_type = 'purchase') as double) / count(*) r,"
        " (select count(distinct user_id) from events) n from events group by 2",
    )
]

# vectors and matrices

_X = (
    "select o_custkey i, sum(o_totalprice) / 1000 value from orders"
    " where o_orderstatus = 'F' group by 1"
)
_Y = (
    "select o_custkey i, cast(count(*) as double) value from orders"
    " where o_orderpriority = '1-URGENT' group by 1"
)
_VECTORS: Ctes = [("x", _X), ("y", _Y)]
_CUST_X = "select c_custkey i, c_acctbal / 1000 value from customer"
_SUPP_X = "select s_suppkey i, s_acctbal / 1000 value from supplier"
_NATION_X = (
    "select cast(c_nationkey as bigint) i, sum(c_acctbal) / 1000 value from customer group by 1"
)
_PURCHASES = (
    "select o_custkey i, l_suppkey j, sum(l_quantity) value from lineitem"
    " join orders on l_orderkey = o_orderkey group by 1, 2"
)
_RETURNS = (
    "select o_custkey i, l_suppkey j, count(*) value from lineitem"
    " join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1, 2"
)


def _trade(col: str) -> str:
    return (
        f"select cast(c_nationkey as bigint) i, l_suppkey j, sum({col}) value from lineitem"
        f" join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"
        f" group by 1, 2"
    )


_MATRICES: Ctes = [("m", _PURCHASES), ("cx", _CUST_X), ("sx", _SUPP_X)]


def oracle_sql() -> dict[str, str]:
    active = [*CUSTOMERS, *_ACTIVE]
    suppliers = [*SUPPLIERS, *_ACTIVE, *_isolated("both"), *_ADJACENCY]
    customers = [*CUSTOMERS, *_ACTIVE, *_isolated("both"), *_ADJACENCY]
    scores = _scores(CUSTOMERS, 3)
    relabelled = [*scores, *_relabel("v", "scores", _part(INFECTED_IN), _part(RECOVERED_IN), SEED, "v1")]
    equal = [*customers, *_transition("cast(1 as double)"), *_walk(5)]
    quotas = [*_SUPPLIER_CURVES, *_COUNTS, *_QUOTAS]
    out: dict[str, str] = {}

    out["top_susceptible"] = _with(
        scores,
        f"select scores.id, round(scores.score, 9) score from scores join v using (id)"
        f" where health_status = 0 order by round(scores.score, 12) desc, id limit {TOP}",
    )
    out["active_vertices"] = _with(active, "select id, score, health_status from act")
    out["active_edges_both"] = _with(active, "select src, dst from e_both")
    out["active_edges_either"] = _with(active, "select src, dst from e_either")
    for scope, name in (("both", ""), ("either", "_either")):
        out[f"isolated_vertices{name}"] = _with(
            [*active, *_isolated(scope)], "select id, score, health_status from iso"
        )
    out["closed_adjacency"] = _with(suppliers, "select i, j, cast(1 as double) value from adj")
    out["closed_adjacency_real"] = _with(
        customers,
        "select i, j, cast(1 as double) value from adj"
        " where i = j or i not in (select id from iso)",
    )
    matrix = "select i, j, round(p, 9) value from p"
    for scope, name in (("both", ""), ("either", "_either")):
        out[f"transition_matrix{name}"] = _with(
            [*active, *_isolated(scope), *_LINKS, *_transition()], matrix
        )
    out["isolated_shares"] = _with(
        [*active, *_transition()[:1]], "select id, round(w / (select sum(w) from w), 12) share from w"
    )
    well = f"select c.id i, c.score value from v c where c.score >= {CUSTOMERS_WITH}"
    out["score_vector"] = _with(
        [*CUSTOMERS, ("s", well)], "select i, value, (select count(*) from s) size from s"
    )
    out["vector_to_scores"] = _with([*CUSTOMERS, ("s", well)], "select i id, value / 2 score from s")
    out["transition_matrix_suppliers"] = _with([*suppliers, *_transition()], matrix)
    for name, net, steps, scope in (
        ("walk_rank_3", CUSTOMERS, 3, "both"),
        ("walk_rank_10", CUSTOMERS, 10, "both"),
        ("walk_rank_either", CUSTOMERS, 3, "either"),
        ("walk_rank_suppliers", SUPPLIERS, 3, "both"),
        ("walk_rank_users", USERS, 3, "both"),
    ):
        out[name] = _with(_scores(net, steps, scope), f"select id, round(r, 9) r from r{steps}")
    for name, net in (("walk_limit", CUSTOMERS), ("walk_limit_suppliers", SUPPLIERS)):
        out[name] = _with([*net, *_ACTIVE, *_isolated("both"), *_LINKS, *_LIMIT], _LIMIT_RANK, recursive=True)
    out["walk_updated"] = _with(_scores(_CHANGED, 3), "select id, round(r, 9) r from r3")
    out["rescore_either"] = _with(_scores(CUSTOMERS, 3, "either"), "select id, round(score, 9) score from scores")
    out["rescore_3"] = _with(scores, "select id, round(score, 9) score from scores")
    out["pagerank_equal_scores"] = _with(equal, "select id, round(r, 9) r from r5")

    out["relabel_topk"] = _with(
        relabelled, "select id, round(score, 9) score, health_status from v1"
    )
    out["relabel_edges"] = _with(relabelled, _pruned("e", "v1_rec"))
    gone = "select id from v where health_status = 1"
    out["prune_edges"] = _with([*CUSTOMERS, ("gone", gone)], _pruned("e", "gone"))

    label = _uniform(SEED, "'label'", "id")
    ill, both = _part(ILL_LABELS_IN), f"({_part(ILL_LABELS_IN)} + {_part(RECOVERED_LABELS_IN)})"
    labels = _with(
        [
            ("v", _CUSTOMER_V),
            ("ranked", f"select id, row_number() over (order by {label}, id) n from v"),
        ],
        f"select id, cast(case when n <= {ill} then 1 else 0 end as double) score,"
        f" cast(case when n <= {ill} then 1 when n <= {both} then -1 else 0 end as integer)"
        f" health_status from ranked",
    )
    out["label_sample"] = out["label_sample_counted"] = out["initial_vertices"] = labels
    out["sample_k"] = out["sample_k_counted"] = _with(
        [("v", _CUSTOMER_V), ("s", _first_in_hash_order("v", _part(SAMPLE_IN)))], "select id from s"
    )
    out["disjoint_pairs"] = out["initial_edges"] = _with(
        [
            ("v", _CUSTOMER_V),
            ("a", _first_in_hash_order("v", _part(PAIRS_IN), "'src'")),
            (
                "b",
                _first_in_hash_order(
                    "v", _part(PAIRS_IN), "'dst'", where="id not in (select id from a)"
                ),
            ),
        ],
        "select least(a.id, b.id) src, greatest(a.id, b.id) dst from a join b using (n)",
    )
    out["dense_index"] = (
        "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) idx from orders"
    )
    out["missing_ranges"] = _with(
        [*CUSTOMERS, *_RANGES], "select src, first, last from gaps where first <= last"
    )
    out["draw_links"] = _with([*CUSTOMERS, *_RANGES, *_drawn_numbers(_part(LINKS_IN))], _NUMBERED_LINKS)
    drawn, links = _skip_links("v", "e", SEED)
    out["propose_links_skip"] = _with([*CUSTOMERS, *drawn], links, recursive=True)
    out["propose_links_chance"] = _with([*CUSTOMERS, *drawn, *_chances(links, SEED)], _CHANCES, recursive=True)

    out["vec_repeat"] = (
        "select i, cast(0.25 as double) value"
        " from (select unnest(range((select count(*) from customer))) i)"
    )
    out["vec_apply_exp"] = (
        f"select i, round(exp({ALPHA} * value / 10), 9) value from ({_CUST_X})"
    )
    out["vec_dot"] = _with(
        _VECTORS,
        "select round(coalesce(sum(x.value * y.value), 0), 6) value from x join y using (i)",
    )
    for name, sign in (("vec_add", "+"), ("vec_sub", "-")):
        out[name] = _with(
            _VECTORS,
            f"select i, round(coalesce(x.value, 0) {sign} coalesce(y.value, 0), 6) value"
            f" from x full join y using (i)",
        )
    out["vec_hadamard"] = _with(
        _VECTORS,
        "select i, round(x.value * y.value, 6) value from x join y using (i)"
        " where x.value * y.value <> 0",
    )
    out["vec_outer"] = _with(
        [("nx", _NATION_X), ("sx", _SUPP_X)],
        "select nx.i, sx.i j, round(nx.value * sx.value, 3) value from nx, sx"
        " where nx.value * sx.value <> 0",
    )
    out["vec_mat"] = _with(
        _MATRICES,
        "select m.j i, round(sum(m.value * cx.value), 6) value from m join cx on cx.i = m.i"
        " group by m.j having sum(m.value * cx.value) <> 0",
    )
    out["mat_vec"] = _with(
        _MATRICES,
        "select m.i, round(sum(m.value * sx.value), 6) value from m join sx on sx.i = m.j"
        " group by m.i having sum(m.value * sx.value) <> 0",
    )
    out["mat_transpose"] = _with(_MATRICES, "select j i, i j, value from m")
    urgent = "select o_custkey i, count(*) value from orders where o_orderpriority = '1-URGENT' group by 1"
    # whole numbers of 2**-72, which all these products are; the text of a whole number is read as the nearest double
    exact = "cast(cast(sum(cast(m.value * x.value * pow(2.0, 72) as hugeint)) as varchar) as double) / pow(2.0, 72)"
    out["vec_dot_exact"] = _with([("x", _CUST_X), ("m", urgent)], f"select {exact} value from x join m using (i)")
    for name, own, other, vector in (("mat_vec_exact", "i", "j", "sx"), ("vec_mat_exact", "j", "i", "cx")):
        out[name] = _with(
            _MATRICES,
            f"select m.{own} i, {exact} value from m join {vector} x on x.i = m.{other} group by 1 having {exact} <> 0",
        )
    for name, own, other, vector in (("mat_vec_stored", "i", "j", "sx"), ("vec_mat_stored", "j", "i", "cx")):
        out[name] = _with(
            _MATRICES,
            f"select m.{own} i, round(sum(m.value * x.value), 6) value, round(sum(m.value * (x.value * x.value)), 6) squares"
            f" from m join {vector} x on x.i = m.{other} group by 1"
            " having sum(m.value * x.value) <> 0 and sum(m.value * (x.value * x.value)) <> 0",
        )
    out["block_matrix"] = out["mat_transpose"]
    out["mat_mul"] = out["mat_mul_grid"] = out["mat_mul_blocks"] = _with(
        [("a", _trade("l_quantity")), ("b", _trade("l_tax"))],
        "select a.i, b.i j, round(sum(a.value * b.value), 4) value from a join b on a.j = b.j"
        " group by a.i, b.i having sum(a.value * b.value) <> 0",
    )
    out["mat_diag"] = _with(_MATRICES, "select i, i j, value from cx")
    out["mat_apply"] = _with(_MATRICES, "select i, j, value / 2 value from m")
    out["mat_scale_cols"] = _with(
        _MATRICES,
        "select m.i, m.j, round(m.value * sx.value, 6) value from m join sx on sx.i = m.j"
        " where m.value * sx.value <> 0",
    )
    out["mat_scale_rows"] = _with(
        _MATRICES,
        "select m.i, m.j, round(m.value * cx.value, 6) value from m join cx on cx.i = m.i"
        " where m.value * cx.value <> 0",
    )
    out["mat_hadamard"] = _with(
        [("m", _PURCHASES), ("t", _RETURNS)],
        "select i, j, m.value * t.value value from m join t using (i, j)"
        " where m.value * t.value <> 0",
    )
    out["matrix_rows"] = _with(
        _MATRICES,
        f"select i, j // {ROW_BLOCK} block,"
        f" string_agg(j || ':' || cast(value as bigint), ' ' order by j) cells"
        f" from m group by 1, 2",
    )

    out["rounded_counts"] = _with(
        [*_SUPPLIER_CURVES, *_COUNTS], "select scenario_id, step, n_s, n_i, n_r from counts"
    )
    every = "select scenario_id, step, new_infected, new_recovered from quotas"
    out["step_quotas"] = _with(quotas, every)
    out["event_quotas"] = _with([*_EVENT_CURVE, *_COUNTS, *_QUOTAS], every)
    out["quota_at"] = _with(quotas, f"{every} where step = {QUOTA_STEP}")
    cursor = ", ".join(
        f"coalesce({fn}(new_{kind}) over (partition by scenario_id order by step), -1)"
        f" {name}_{kind}"
        for kind in ("infected", "recovered")
        for fn, name in (("lag", "previous"), ("lead", "next"))
    )
    out["quota_cursor"] = _with(
        [*_EVENT_CURVE, *_COUNTS, *_QUOTAS],
        f"select scenario_id, step, new_infected, new_recovered, {cursor} from quotas",
    )
    out["scenario_grid"] = _with(
        [*_SUPPLIER_SCENARIOS, *_GRID],
        "select scenario_id, beta, gamma, n, round(i0, 9) i0, round(r0, 9) r0,"
        " cast(20 as integer) t_end, cast(1 as double) step_size from grid",
    )
    out["peak_infected"] = _with(
        _SUPPLIER_CURVES, "select scenario_id, round(max(i), 3) peak from curve group by 1"
    )

    out["snapshot_vertices"] = _with(CUSTOMERS, "select id, score, health_status from v")
    out["snapshot_edges_csv"] = _with(CUSTOMERS, "select src, dst from e")
    out["observed_curve"] = _with(
        [
            (
                "held",
                "select cast(date_diff('month', (select min(o_orderdate) from orders), o_orderdate) as integer) step,"
                " o_custkey, count(*) n, count(*) filter (o_orderpriority = '1-URGENT') urgent,"
                " count(*) filter (o_orderstatus = 'F') filled from orders group by 1, 2",
            )
        ],
        "select step, count(*) filter (urgent = 0 and filled < n) n_s, count(*) filter (urgent > 0) n_i,"
        " count(*) filter (urgent = 0 and filled = n) n_r from held group by step",
    )
    stays = f"{{}} % {CHANGED_IN} <> 4"
    later: Ctes = [
        *_CHANGED,
        ("v2", f"select * from v where {stays.format('id')}"),
        ("e2", f"select * from e where {stays.format('src')} and {stays.format('dst')}"),
    ]
    out["delta_vertices"] = _with(later, "select id, score, health_status from v2")
    out["delta_edges"] = _with(later, "select src, dst from e2")
    out["delta_counts"] = _with(
        later,
        " union all ".join(
            f"select cast({k} as integer) step, count(*) filter (health_status = 0) n_s,"
            f" count(*) filter (health_status = 1) n_i, count(*) filter (health_status = -1) n_r,"
            f" (select count(*) from {e}) n_edges from {v}"
            for k, (v, e) in enumerate((("v0", "e0"), ("v", "e"), ("v2", "e2")))
        ),
    )
    out["foreign_csv_vertices"], out["foreign_csv_edges"] = (
        out["snapshot_vertices"],
        out["snapshot_edges_csv"],
    )
    return out
