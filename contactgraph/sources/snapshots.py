"""Per-step snapshots of a network: ``<base>/vertices|edges/step=<k>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactgraph.schema import EDGES, VERTICES, Network, canonical_edges

_FORMATS = ("parquet", "csv")
_STEP = T.StructField("step", T.IntegerType(), False)
_COMPLETE = T.StructField("complete", T.BooleanType(), False)


def _check(fmt: str, step: int | None = None) -> None:
    if fmt not in _FORMATS:
        raise ValueError(f"fmt must be one of {_FORMATS}, got {fmt!r}")
    if step is not None and step < 0:
        raise ValueError(f"step must not be negative, got {step}")


def table_path(base: str, table: str, step: int | None = None) -> str:
    root = f"{base.rstrip('/')}/{table}"
    return root if step is None else f"{root}/step={step}"


def write_snapshot(
    net: Network, base: str, step: int, fmt: str = "parquet", input_step: int | None = None
) -> None:
    """Write both tables of one step, replacing only that step.

    ``input_step`` is the step the network was read from; it must be another
    one, for a job cannot replace the files it is reading. CSV has no header.
    A mark is taken away first and written last; readers require it, so a step
    whose writing failed is never read as a whole.
    """
    _check(fmt, step)
    if input_step == step:
        raise ValueError(f"step {step} is being read and cannot be overwritten")
    # sorted files give narrow row-group ranges at no shuffle
    tables = (
        ("vertices", net.vertices.select(*VERTICES.names).sortWithinPartitions("id")),
        ("edges", net.edges.select(*EDGES.names).sortWithinPartitions("src", "dst")),
    )
    spark = net.vertices.sparkSession
    _mark(spark, base, step, False)
    for table, df in tables:
        df.write.mode("overwrite").format(fmt).save(table_path(base, table, step))
    _mark(spark, base, step, True)


def write_history(vertices: DataFrame, edges: DataFrame, base: str, fmt: str = "parquet") -> None:
    """Write the snapshots of many steps in one go, replacing those steps.

    Both tables have a column ``step`` beside those of a network, and neither may
    come from the steps that are replaced. Marks are taken away first and written
    last, as for one snapshot; a step without vertices is none.
    """
    _check(fmt)
    steps = vertices.select(F.col("step").cast("int").alias("step")).distinct()

    def marked(complete: bool) -> None:
        rows = steps.select(F.lit(complete).alias("complete"), "step").coalesce(1)
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("step").parquet(table_path(base, "marks"))

    marked(False)
    for table, df, schema in (("vertices", vertices, VERTICES), ("edges", edges, EDGES)):
        order = ["step", *(["id"] if table == "vertices" else ["src", "dst"])]
        # a long step is several ranges, and a range few steps, so files are neither many nor long
        laid = df.select(*schema.names, "step").repartitionByRange(*order).sortWithinPartitions(*order)
        writer = laid.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
        writer.partitionBy("step").format(fmt).save(table_path(base, table))
    marked(True)


def _mark(spark: SparkSession, base: str, step: int, complete: bool) -> None:
    row = spark.range(1).select(F.lit(complete).alias("complete"))
    row.write.mode("overwrite").parquet(table_path(base, "marks", step))


def complete_steps(spark: SparkSession, base: str) -> list[int]:
    """Steps that were written to their end, one number per snapshot."""
    marks = spark.read.schema(T.StructType([_COMPLETE, _STEP])).parquet(table_path(base, "marks"))
    return sorted(r["step"] for r in marks.filter("complete").select("step").collect())


def read_snapshot(
    spark: SparkSession, base: str, step: int, fmt: str = "parquet", canonical: bool = True
) -> Network:
    """The network of one step. ``canonical=False`` puts the edges of foreign
    files into canonical form."""
    _check(fmt, step)
    if step not in complete_steps(spark, base):
        raise ValueError(f"step {step} below {base} is not complete")
    return read_tables(
        spark,
        table_path(base, "vertices", step),
        table_path(base, "edges", step),
        fmt,
        canonical,
    )


def read_tables(
    spark: SparkSession,
    vertices_path: str,
    edges_path: str,
    fmt: str = "csv",
    canonical: bool = False,
) -> Network:
    """A network from any two paths: headerless CSV in column order, or Parquet.

    The schema is given, so no pass over the files is spent on inference.
    """
    _check(fmt)
    source = T.StructType(
        [
            f if f.name != "health_status" or fmt == "parquet"
            # foreign CSV may write the status as 1.0
            else T.StructField(f.name, T.DoubleType(), False)
            for f in VERTICES
        ]
    )
    vertices = spark.read.schema(source).format(fmt).load(vertices_path)
    vertices = vertices.withColumn("health_status", F.col("health_status").cast("int"))
    edges = spark.read.schema(EDGES).format(fmt).load(edges_path)
    return Network(vertices, edges if canonical else canonical_edges(edges))


def read_history(
    spark: SparkSession, base: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of all complete steps, with a ``step`` partition column."""
    _check(fmt)
    steps = complete_steps(spark, base)

    def read(table: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, _STEP])
        return spark.read.schema(full).format(fmt).load(table_path(base, table)).filter(F.col("step").isin(steps))

    return read("vertices", VERTICES), read("edges", EDGES)
