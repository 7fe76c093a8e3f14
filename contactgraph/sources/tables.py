"""Contact networks, vectors, matrices and scenarios derived from order and
event tables. Every function reads its tables whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgraph.functions.ordering import with_next
from contactgraph.operators.sparse import SparseMat, SparseVec, matrix_from_df, vector_from_df
from contactgraph.schema import (
    EDGES,
    INFECTED,
    RECOVERED,
    SCENARIOS,
    SUSCEPTIBLE,
    VERTICES,
    Network,
    canonical_edges,
    conform,
)
from contactgraph.session import ROWS_PER_PARTITION, spread

# More order lines than this are spread by count: a task sorts, joins and groups
# them, which takes many times the bytes that adaptive coalescing goes by.
MANY_LINES = 8 * ROWS_PER_PARTITION


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _share_of_balance(col: str):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(col) / F.lit(10000.0)))


# networks


def customer_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers; two market segments count as infected and recovered."""
    segment = F.col("c_mktsegment")
    return conform(
        load(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("id"),
            F.when(segment == "MACHINERY", 0.0)
            .when(segment == "BUILDING", 1.0)
            .otherwise(_share_of_balance("c_acctbal"))
            .alias("score"),
            F.when(segment == "MACHINERY", RECOVERED)
            .when(segment == "BUILDING", INFECTED)
            .otherwise(SUSCEPTIBLE)
            .alias("health_status"),
        ),
        VERTICES,
    )


def customer_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders that follow each other on one day with one priority."""
    orders = load(spark, sf_dir, "orders").select(
        "o_orderdate", "o_orderkey", "o_custkey", "o_orderpriority"
    )
    pairs = with_next(
        orders, ["o_orderdate", "o_orderkey"], ["o_custkey", "o_orderpriority", "o_orderdate"]
    ).filter(
        (F.col("o_orderdate") == F.col("next_o_orderdate"))
        & (F.col("o_orderpriority") == F.col("next_o_orderpriority"))
    )
    return canonical_edges(
        pairs.select(F.col("o_custkey").alias("src"), F.col("next_o_custkey").alias("dst"))
    )


def customer_network(spark: SparkSession, sf_dir: str) -> Network:
    return Network(customer_vertices(spark, sf_dir), customer_contacts(spark, sf_dir))


def _month(first_day) -> Column:
    first = 12 * first_day.year + first_day.month if first_day else 0
    return (12 * F.year("o_orderdate") + F.month("o_orderdate") - first).cast("int")


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with ``step``, the months since the first."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return orders.withColumn("step", _month(orders.agg(F.min("o_orderdate")).first()[0]))


def monthly_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, score, health_status, step)``: the customers that ordered in a month;
    infected with an urgent order in it, else recovered when all orders are filled."""
    held = _dated_orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("id"), "step").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"),
        F.count("*").alias("orders"),
    )
    ill, done = F.col("urgent") > 0, F.col("filled") == F.col("orders")
    return held.select(
        "id",
        F.when(ill, 1.0).when(done, 0.0).otherwise(F.col("filled") / F.col("orders")).alias("score"),
        F.when(ill, INFECTED).when(done, RECOVERED).otherwise(SUSCEPTIBLE).alias("health_status"),
        "step",
    )


def monthly_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, step)``: customers next to each other by number among those of a month."""
    held = _dated_orders(spark, sf_dir).select(F.col("o_custkey").alias("src"), "step").distinct()
    pairs = with_next(held, ["step", "src"], ["step", "src"]).filter("step = next_step")
    return pairs.select("src", F.col("next_src").alias("dst"), "step")


def supplier_network(spark: SparkSession, sf_dir: str) -> Network:
    """Suppliers, all susceptible; neighbours by balance within a nation when
    the balances differ by less than 500."""
    supplier = load(spark, sf_dir, "supplier")
    vertices = supplier.select(
        F.col("s_suppkey").alias("id"),
        _share_of_balance("s_acctbal").alias("score"),
        F.lit(SUSCEPTIBLE).alias("health_status"),
    )
    pairs = with_next(
        supplier.select("s_nationkey", "s_acctbal", "s_suppkey"),
        ["s_nationkey", "s_acctbal", "s_suppkey"],
        ["s_nationkey", "s_acctbal", "s_suppkey"],
    ).filter(
        (F.col("s_nationkey") == F.col("next_s_nationkey"))
        & (F.col("next_s_acctbal") - F.col("s_acctbal") < 500)
    )
    edges = pairs.select(F.col("s_suppkey").alias("src"), F.col("next_s_suppkey").alias("dst"))
    return Network(conform(vertices, VERTICES), canonical_edges(edges))


def user_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the event log; the share of errors sets score and status."""
    users = (
        load(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.count("*").alias("total"),
        )
    )
    ill = F.col("errors") * 4 >= F.col("total")
    immune = F.col("errors") * 20 <= F.col("total") * 3
    return conform(
        users.select(
            F.col("user_id").alias("id"),
            F.when(ill, 1.0)
            .when(immune, 0.0)
            .otherwise(F.col("errors").cast("double") / F.col("total"))
            .alias("score"),
            F.when(ill, INFECTED)
            .when(immune, RECOVERED)
            .otherwise(SUSCEPTIBLE)
            .alias("health_status"),
        ),
        VERTICES,
    )


def user_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events of one type follow each other within ten minutes."""
    events = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    pairs = with_next(
        events, ["event_type", "ts", "event_id"], ["event_type", "ts", "user_id"]
    ).filter(
        (F.col("event_type") == F.col("next_event_type"))
        & (F.col("next_ts") - F.col("ts") <= F.expr("interval 10 minutes"))
    )
    return canonical_edges(
        pairs.select(F.col("user_id").alias("src"), F.col("next_user_id").alias("dst"))
    )


def user_network(spark: SparkSession, sf_dir: str) -> Network:
    return Network(user_vertices(spark, sf_dir), user_contacts(spark, sf_dir))


# vectors and matrices


def _places(df: DataFrame, key: str) -> int:
    return df.agg(F.coalesce(F.max(key), F.lit(-1))).first()[0] + 1


def customer_places(spark: SparkSession, sf_dir: str) -> int:
    return _places(load(spark, sf_dir, "customer"), "c_custkey")


def supplier_places(spark: SparkSession, sf_dir: str) -> int:
    return _places(load(spark, sf_dir, "supplier"), "s_suppkey")


def nation_places(spark: SparkSession, sf_dir: str) -> int:
    return _places(load(spark, sf_dir, "nation"), "n_nationkey")


def filled_orders(spark: SparkSession, sf_dir: str) -> SparseVec:
    """Value of each customer's filled orders, in thousands."""
    orders = load(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    spent = orders.groupBy("o_custkey").agg((F.sum("o_totalprice") / 1000).alias("value"))
    return vector_from_df(spent, customer_places(spark, sf_dir), i="o_custkey")


def urgent_orders(spark: SparkSession, sf_dir: str) -> SparseVec:
    """Number of each customer's urgent orders."""
    orders = load(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("value"))
    return vector_from_df(counts, customer_places(spark, sf_dir), i="o_custkey")


def customer_balance(spark: SparkSession, sf_dir: str) -> SparseVec:
    customer = load(spark, sf_dir, "customer")
    return vector_from_df(
        customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("value")),
        _places(customer, "c_custkey"),
        i="c_custkey",
    )


def supplier_balance(spark: SparkSession, sf_dir: str) -> SparseVec:
    supplier = load(spark, sf_dir, "supplier")
    return vector_from_df(
        supplier.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("value")),
        _places(supplier, "s_suppkey"),
        i="s_suppkey",
    )


def nation_balance(spark: SparkSession, sf_dir: str) -> SparseVec:
    """Customers' balance per nation, in thousands."""
    totals = (
        load(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg((F.sum("c_acctbal") / 1000).alias("value"))
    )
    return vector_from_df(totals, nation_places(spark, sf_dir), i="c_nationkey")


def _order_lines(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *cols)
    rows = load(spark, sf_dir, "lineitem").count()
    if rows > MANY_LINES:
        lines = spread(lines, "l_orderkey", rows=rows)
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey"
    )
    return lines.join(orders, "l_orderkey")


def purchases(spark: SparkSession, sf_dir: str) -> SparseMat:
    """Quantity each customer bought from each supplier."""
    cells = (
        _order_lines(spark, sf_dir, "l_quantity")
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("value"))
    )
    return matrix_from_df(
        cells,
        customer_places(spark, sf_dir),
        supplier_places(spark, sf_dir),
        "o_custkey",
        "l_suppkey",
    )


def returns(spark: SparkSession, sf_dir: str) -> SparseMat:
    """Number of lines each customer returned to each supplier."""
    cells = (
        _order_lines(spark, sf_dir, "l_returnflag")
        .filter(F.col("l_returnflag") == "R")
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.count("*").alias("value"))
    )
    return matrix_from_df(
        cells,
        customer_places(spark, sf_dir),
        supplier_places(spark, sf_dir),
        "o_custkey",
        "l_suppkey",
    )


def trade(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> SparseMat:
    """``value`` summed per customer nation and supplier."""
    nation_of = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"
    )
    cells = (
        _order_lines(spark, sf_dir, value)
        .join(nation_of, "o_custkey")
        .groupBy("c_nationkey", "l_suppkey")
        .agg(F.sum(value).alias("value"))
    )
    return matrix_from_df(
        cells,
        nation_places(spark, sf_dir),
        supplier_places(spark, sf_dir),
        "c_nationkey",
        "l_suppkey",
    )


# scenarios and curves


def _scenario(counts: DataFrame) -> DataFrame:
    """Scenario rows from ``(scenario_id, beta, n, infected, recovered)``."""
    return conform(
        counts.select(
            "scenario_id",
            "beta",
            F.lit(0.05).alias("gamma"),
            "n",
            (F.col("infected").cast("double") / F.col("n")).alias("i0"),
            (F.col("recovered").cast("double") / F.col("n")).alias("r0"),
            F.lit(20).alias("t_end"),
            F.lit(1.0).alias("step_size"),
        ),
        SCENARIOS,
    )


def _status_counts() -> list:
    return [
        F.count("*").alias("n"),
        F.count_if(F.col("health_status") == INFECTED).alias("infected"),
        F.count_if(F.col("health_status") == RECOVERED).alias("recovered"),
    ]


def supplier_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per supplier, over the customers it has served; beta rises
    with the number of the supplier's region."""
    served = (
        _order_lines(spark, sf_dir)
        .select(F.col("l_suppkey").alias("scenario_id"), F.col("o_custkey").alias("id"))
        .distinct()
        .join(customer_vertices(spark, sf_dir), "id")
        .groupBy("scenario_id")
        .agg(*_status_counts())
    )
    region = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    beta = region.select(
        F.col("s_suppkey").alias("scenario_id"),
        (F.lit(0.35) + F.lit(0.05) * F.col("n_regionkey")).alias("beta"),
    )
    return _scenario(served.join(beta, "scenario_id"))


def event_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shares of three groups of events, as one observed curve; steps are
    days since the first event."""
    events = load(spark, sf_dir, "events")
    n_users, first_day = events.agg(F.countDistinct("user_id"), F.min(F.to_date("ts"))).first()

    def share(*kinds: str):
        return F.count_if(F.col("event_type").isin(*kinds)).cast("double") / F.count("*")

    return (
        events.groupBy(F.date_diff(F.to_date("ts"), F.lit(first_day)).alias("step"))
        .agg(
            share("view", "click", "signup").alias("s"),
            share("error").alias("i"),
            share("purchase").alias("r"),
        )
        .select(
            F.lit(0).cast("long").alias("scenario_id"),
            "step",
            "s",
            "i",
            "r",
            F.lit(n_users).cast("long").alias("n"),
        )
    )


def supplier_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observed curve per supplier: by months since the first shipment of
    all, the shares of its lines that are new, returned and accepted; ``n`` is
    its number of lines."""
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag")
    first_day = lines.agg(F.min("l_shipdate")).first()[0]
    first_month = 12 * first_day.year + first_day.month if first_day else 0
    month = 12 * F.year("l_shipdate") + F.month("l_shipdate") - first_month
    lines_of = Window.partitionBy("l_suppkey")

    def share(flag: str):
        return F.count_if(F.col("l_returnflag") == flag).cast("double") / F.count("*")

    return (
        lines.groupBy("l_suppkey", month.cast("int").alias("step"))
        .agg(share("N").alias("s"), share("R").alias("i"), share("A").alias("r"), F.count("*").alias("lines"))
        .select(
            F.col("l_suppkey").cast("long").alias("scenario_id"),
            "step",
            "s",
            "i",
            "r",
            F.sum("lines").over(lines_of).alias("n"),
        )
    )
