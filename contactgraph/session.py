"""Session settings for local runs, and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Rows of a hash-partitioned table that one partition is to hold.
ROWS_PER_PARTITION = 2_000_000


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "4g", **conf
) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("contactgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, reachable by all executors.

    Only a local master, where one machine holds everything, gets a temporary
    folder when the setting is absent; it is removed when Python ends.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="contactgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from there, so that
    a lost executor costs a re-read and the plan does not grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partition_count(spark: SparkSession, rows: int, per_partition: int | None = None) -> int:
    """Partitions for ``rows`` rows, not fewer than the session's setting."""
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(setting, -(-rows // (per_partition or ROWS_PER_PARTITION)))


def spread(df: DataFrame, *cols: str, rows: int = 0) -> DataFrame:
    """Hash-partition by count instead of by size: for rows that are small but
    grow into many in the next step, which adaptive coalescing cannot know.
    ``rows`` is the number of rows that the next step makes."""
    return df.repartition(partition_count(df.sparkSession, rows), *cols)
