"""
the bindings must reproduce them."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def counts(df, *cols):
    return {tuple(r[c] for c in cols): r["n"] for r in df.groupBy(*cols).count()
            .withColumnRenamed("count", "n").collect()}


def test_reconcile_counts(spark):
    got = {r["status"]: r["n_artifacts"] for r in E.queries()["reconcile_counts"](spark, SF).collect()}
    assert got == {"collected": 14743, "conflict": 45257, "missing": 257}


def test_lifecycle_check_counts(spark):
    got = counts(E.queries()["lifecycle_check"](spark, SF), "action", "verdict")
    assert got == {("start", "ok"): 150, ("start", "already_started"): 1867,
                   ("stop", "not_started"): 160, ("stop", "ok"): 150, ("stop", "noop"): 1704,
                   ("collect", "not_started"): 190, ("collect", "still_running"): 167,
                   ("collect", "ok"): 1624}


def test_stop_escalation_counts(spark):
    got = counts(E.queries()["stop_escalation"](spark, SF), "outcome")
    assert got == {("terminated",): 403, ("killed",): 269, ("not_stopped",): 1342}


def test_first_wins_duplicates(spark):
    df = E.queries()["first_wins"](spark, SF)
    assert df.filter("NOT kept").count() == 60000 - df.filter("kept").count()
    assert df.filter("kept").count() == df.select("l_orderkey", "l_linenumber").distinct().count()
