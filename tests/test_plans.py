"""Plan checks: no Python in batch operators, no Cartesian products, filters
pushed to the scan, partial top-n before the shuffle."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from helpers import SF_SMALL
from fleetlens.plans.catalog import QUERIES

# these read back what they wrote; streams are looked at in test_lifecycle
STREAMS = {"periodic_stats_stream", "lifecycle_stream", "lifecycle_monitor", "read_stats", "write_new"}
BATCH = sorted(set(QUERIES) - STREAMS)


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_capture_filter_pushdown(spark):
    p = plan(E.queries()["capture_filter"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p


def test_lifecycle_filter_pushdown_and_pruning(spark):
    p = plan(E.queries()["lifecycle_check"](spark, SF_SMALL))
    assert "In(event_type" in p
    assert "props" not in p.split("ReadSchema:")[1].splitlines()[0]


def test_retry_outcome_partial_group_limit(spark):
    p = plan(E.queries()["retry_outcome"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_reconcile_flags_winners_without_join_back(spark):
    # first-wins per destination is one window, not winners joined back
    p = plan(E.queries()["reconcile"](spark, SF_SMALL))
    tree = p.split("\n\n")[0]
    assert "Window" in tree and "SortMergeJoin" not in tree


def test_registry_and_axes_are_broadcast(spark):
    for name in ("route_specs", "sweep_grid"):
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "BroadcastHashJoin" in p, name
