"""Every registered query against its SQL, over whole small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
from contactgraph.plans import catalog, oracles  # noqa: E402

QUERIES = catalog.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return check_oracles.connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    result = check_oracles.compare(spark, con, small, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
