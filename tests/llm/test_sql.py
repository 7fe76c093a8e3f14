"""Queries of the training-data operators against their SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

from contactgraph.llm import oracles, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import check_oracles  # noqa: E402


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op6_source_mixing"])
def test_query_against_its_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    result = check_oracles.compare(spark, con, small, name, queries.queries()[name], oracles.oracle_sql()[name])
    assert result.startswith("ok"), result
