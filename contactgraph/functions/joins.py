"""Joins on a key that a large share of the rows may have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``left``, where ``key`` may be hot, with ``right``, where it is
    unique (``inner``, ``left``, ``left_semi`` or ``left_anti``).

    Adaptive execution splits a hot partition only when both sides come to the
    join straight from a shuffle made for it. An aggregate or a partitioned
    table on the same key would be reused as it is and stay unsplit. The second
    join column, the same for all rows, rules that reuse out.
    """
    one = F.pmod(F.xxhash64(key), F.lit(1))
    joined = left.withColumn("_split", one).join(
        right.withColumn("_split", one), [key, "_split"], how
    )
    return joined.drop("_split")
