"""Every registered query equals its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from check import compare, duck
from helpers import SF_SMALL
from fleetlens.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL)
    assert r.get("match"), r


def test_entry(spark):
    df = E.entry(spark)
    got = {r["status"]: r["n_artifacts"] for r in df.collect()}
    assert set(got) <= {"collected", "conflict", "missing"}
    assert sum(got.values()) > 0
