import pytest
"""Operator semantics on small literal frames."""

from pyspark.sql import functions as F

from helpers import rows
from fleetlens.functions.flatten import flatten_paths
from fleetlens.functions.params import render_map, render_params
from fleetlens.operators.asof import next_event
from fleetlens.operators.dedupe import first_wins, last_wins
from fleetlens.operators.defaults import apply_map_defaults
from fleetlens.operators.ordering import order_tasks, timeline
from fleetlens.operators.rollup import failure_rollup, required_dirs, retry_outcome
from fleetlens.operators.sweep import decode_run, sweep_grid


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("d1", 2, "b"), ("d1", 1, "a"), ("d1", 3, "c"), ("d2", 5, "x")],
                               "dst string, pos int, name string")
    f = first_wins(df, ["dst"], ["pos"])
    l = last_wins(df, ["dst"], ["pos"])
    assert rows(f.filter("kept"), "name") == [("a",), ("x",)]
    assert rows(l.filter("kept"), "name") == [("c",), ("x",)]
    assert f.count() == 4 and l.count() == 4


def test_null_key_is_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "k string, pos int")
    assert rows(first_wins(df, ["k"], ["pos"]), "pos", "kept") == [(1, True), (2, False)]


def test_retry_outcome(spark):
    tasks = spark.createDataFrame([(i,) for i in range(1, 5)], "t int")
    att = spark.createDataFrame([(1, 1, True), (2, 1, False), (2, 2, True),
                                 (3, 1, False), (3, 2, False), (3, 3, True)],
                                "t int, n int, ok boolean")
    out = retry_outcome(tasks, att, ["t"], ["n"], F.col("ok"))
    assert rows(out, "t", "n_attempts", "outcome") == [
        (1, 1, "ok_first"), (2, 2, "ok_retry"), (3, 2, "failed"), (4, 0, "skipped")]


def test_failure_rollup(spark):
    df = spark.createDataFrame([("r1", True, False), ("r1", False, True), ("r2", False, False)],
                               "run string, ns boolean, cf boolean")
    out = failure_rollup(df, ["run"], F.col("ns"), F.col("cf"))
    assert rows(out) == [("r1", 2, 1, 1, False), ("r2", 1, 0, 0, True)]


def test_order_tasks_parity_and_stop_order(spark):
    df = spark.createDataFrame([("r", 0, None), ("r", 1, 2), ("r", 2, 1), ("r", 3, None)],
                               "run string, pos int, stop_order int")
    parity = order_tasks(df, ["run"], ["pos"])
    assert rows(parity, "pos", "start_rank", "stop_rank") == [(0, 1, 4), (1, 2, 3), (2, 3, 2), (3, 4, 1)]
    honor = order_tasks(df, ["run"], ["pos"], honor_stop_order=True)
    assert rows(honor, "pos", "stop_rank") == [(0, 4), (1, 2), (2, 1), (3, 3)]


def test_timeline(spark):
    df = spark.createDataFrame([("r", 0, 5, 0), ("r", 1, 11, 2), ("r", 2, 5, 1)],
                               "run string, pos int, sc int, pc int")
    out = timeline(df, ["run"], ["pos"], F.col("sc").cast("bigint"), F.col("pc").cast("bigint"), 70)
    assert rows(out, "pos", "start_at", "ready_at", "stop_at") == [
        (0, 0, 5, 94), (1, 5, 16, 92), (2, 16, 21, 91)]


def test_next_event_tie_break(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, t, "a"), (2, 1, t, "b"), (0, 1, t, "b"),
                                (3, 1, t + dt.timedelta(seconds=1), "b")],
                               "event_id bigint, k bigint, ts timestamp_ntz, kind string")
    out = next_event(df, ["k"], ["ts", "event_id"], F.col("kind") == "a", F.col("kind") == "b",
                     carry=["event_id"])
    assert rows(out, "event_id", "next_event_id", "delay_us") == [(1, 2, 0)]


def test_render_null_text_and_order(spark):
    df = spark.createDataFrame([({"a": "1", "b": None},)], "m map<string,string>")
    assert df.select(render_map("m")).first()[0] == "a=1&b=None"
    long = spark.createDataFrame([("r", 2, "y", "2"), ("r", 1, "x", None)],
                                 "run string, pos int, k string, v string")
    assert render_params(long, ["run"], ["pos"], "k", "v").first()["params"] == "x=None&y=2"


def test_map_defaults_absent_vs_null(spark):
    df = spark.createDataFrame([({"host": None},), ({},), ({"host": "h"},)], "m map<string,string>")
    out = apply_map_defaults(df, "m", {"host": ""}, overrides={})
    assert sorted("<null>" if r["host"] is None else r["host"] for r in out.collect()) == ["", "<null>", "h"]
    out2 = apply_map_defaults(df, "m", {"host": ""}, overrides={"host": F.lit("o")})
    assert {r["host"] for r in out2.collect()} == {"o"}


def test_flatten_first_occurrence_and_segment(spark):
    df = spark.createDataFrame([(1, "root/run1/u@h1", "a.csv"), (2, "root/en/x/en", "b.csv"),
                                (3, "root/entry/en", "c.csv"), (4, "root/run2", "d.csv")],
                               "id int, dir string, file string")
    sub = flatten_paths(df, "dir", "file", ["/en", "/u@h1"])
    assert rows(sub, "id", "dst", "subfolder") == [
        (1, "root/run1/a.csv", "/u@h1"), (2, "root/x/en/b.csv", "/en"), (3, "roottry/en/c.csv", "/en")]
    seg = flatten_paths(df, "dir", "file", ["/en", "/u@h1"], segment=True)
    assert rows(seg, "id", "dst") == [(1, "root/run1/a.csv"), (2, "root/x/en/b.csv"),
                                      (3, "root/entry/c.csv")]


def test_flatten_collision_last_wins(spark):
    df = spark.createDataFrame([(1, "r/h1", "s.csv"), (2, "r/h2", "s.csv")],
                               "id int, dir string, file string")
    out = flatten_paths(df, "dir", "file", ["/h1", "/h2"])
    assert rows(out, "id", "dst", "kept") == [(1, "r/s.csv", False), (2, "r/s.csv", True)]


def test_sweep_grid_and_decode(spark):
    axes = {"rtt": spark.createDataFrame([("20",), ("40",)], "v string"),
            "loss": spark.createDataFrame([("0",), ("1",), ("0",)], "v string")}
    g = sweep_grid(spark, axes)
    assert rows(g, "run") == [("_rtt20_loss0",), ("_rtt20_loss1",), ("_rtt40_loss0",), ("_rtt40_loss1",)]
    back = g.select("run", *decode_run(F.col("run"), ["rtt", "loss"]))
    assert rows(back, "rtt", "loss") == rows(g, "rtt", "loss")


def test_required_dirs_distinct(spark):
    df = spark.createDataFrame([("local", "/a/b/x.csv"), ("local", "/a/b/y.csv"), ("u@h", "/a/b/x")],
                               "origin string, path string")
    assert rows(required_dirs(df, "origin", "path")) == [("local", "/a/b"), ("u@h", "/a/b")]


def test_reconcile_precheck_and_transfer_error(spark):
    from fleetlens.operators.reconcile import reconcile
    exp = spark.createDataFrame(
        [("t1", "/a/x", "d/x", 0, None), ("t2", "/b/x", "d/x", 1, None),
         ("t3", "/c/y", "d/y", 2, "not_stopped"), ("t4", "/d/z", "d/z", 3, None),
         ("t5", "/e/w", "d/w", 4, None)],
        "task string, path string, destination string, pos int, precheck string")
    found = spark.createDataFrame([("/a/x", True), ("/b/x", True), ("/c/y", True), ("/e/w", False)],
                                  "path string, transfer_ok boolean")
    r = reconcile(exp, found, on=["path"], destination="destination", order=["pos"],
                  precheck="precheck", transfer_ok="transfer_ok")
    assert rows(r, "task", "status") == [("t1", "collected"), ("t2", "conflict"),
                                         ("t3", "not_stopped"), ("t4", "missing"), ("t5", "error")]


def test_exactly_one_winner_whatever_the_type(spark):
    for value in ("'x'", "1", "DATE'2020-01-01'"):
        df = spark.range(5).selectExpr("'d' AS dst", f"{value} AS name")
        assert first_wins(df, ["dst"], ["name"]).filter("kept").count() == 1
        assert last_wins(df, ["dst"], ["name"]).filter("kept").count() == 1


def test_reconcile_gives_one_status_to_an_artifact(spark):
    from fleetlens.operators.reconcile import reconcile
    exp = spark.createDataFrame(
        [("r1", 0, "/a", "d/a", None, True), ("r1", 1, "/b", "d/a", None, True), ("r1", 2, "/none", "d/n", None, True),
         ("r1", 3, "/a", "d/c", None, False), ("r1", 4, "/b", "d/c", None, True), ("r2", 0, "/a", "d/a", None, True),
         ("r2", 1, "/b", "d/x", "not_stopped", True), ("r2", 2, "/b", "d/x", None, True)],
        "run string, pos int, path string, destination string, precheck string, ok boolean")
    found = spark.createDataFrame([("/a", 1), ("/a", 2), ("/b", 1)], "path string, copy int")
    kw = dict(on=["path"], destination="destination", order=["run", "pos"], precheck="precheck", transfer_ok="ok")
    got = {(r["run"], r["pos"]): r["status"] for r in reconcile(exp, found, **kw).collect()}
    assert got == {("r1", 0): "collected", ("r1", 1): "conflict", ("r1", 2): "missing", ("r1", 3): "error", ("r1", 4): "collected",
                   ("r2", 0): "conflict", ("r2", 1): "not_stopped", ("r2", 2): "collected"}
    apart = {(r["run"], r["pos"]): r["status"] for r in reconcile(exp, found, scope=["run"], **kw).collect()}
    assert apart == {**got, ("r2", 0): "collected"}


def test_first_wins_string_order(spark):
    df = spark.createDataFrame([("d", "b"), ("d", "a"), ("e", "z")], "dst string, name string")
    assert rows(first_wins(df, ["dst"], ["name"]).filter("kept"), "name") == [("a",), ("z",)]
    assert rows(last_wins(df, ["dst"], ["name"]).filter("kept"), "name") == [("b",), ("z",)]


def test_first_wins_hot_keys_same(spark):
    from fleetlens.plans.skew import flag_extreme
    from fleetlens.plans.catalog import LINE_COLS
    from fleetlens.sources.tables import table
    li = table(spark, "/root/testdata/sf0.001", "lineitem").select(*LINE_COLS)
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
    for first in (True, False):
        a = flag_extreme(li, ["l_orderkey"], order, first=first)
        b = flag_extreme(li, ["l_orderkey"], order, first=first, hot_rows=2)
        assert rows(a) == rows(b)


def test_missing_and_present_artifacts(spark):
    from fleetlens.operators.reconcile import missing_artifacts, present_artifacts
    exp = spark.createDataFrame([("t1", "/a"), ("t2", "/b"), ("t3", "/c")], "task string, path string")
    found = spark.createDataFrame([("/a",), ("/a",), ("/c",), ("/z",)], "path string")
    assert rows(missing_artifacts(exp, found, ["path"]), "task") == [("t2",)]
    assert rows(present_artifacts(exp, found, ["path"]), "task") == [("t1",), ("t3",)]


def _walked(files, names):
    """A plain walk: (number, dir, name) -> number: (final path or None, moves, replaced at)."""
    there = {}
    for n, d, f in files:
        there.setdefault(d, {})[f] = n
    folders = {"/".join(d.split("/")[:i]) for d in there for i in range(1, len(d.split("/")) + 1)}
    moves, gone = {n: 0 for n, _, _ in files}, {}
    for d in sorted(folders, key=lambda d: d.split("/")):
        to = next((d.replace(x, "", 1) for x in names if x in d), None)
        if to is None:
            continue
        for f, n in sorted(there.pop(d, {}).items()):
            old = there.setdefault(to, {}).get(f)
            if old is not None:
                gone[old] = (to + f if to == "" or to.endswith("/") else f"{to}/{f}")
            there[to][f] = n
            moves[n] += 1
    out = {n: (d + f if d == "" or d.endswith("/") else f"{d}/{f}", moves[n], None) for d, x in there.items() for f, n in x.items()}
    return out | {n: (None, moves[n], at) for n, at in gone.items()}


@pytest.mark.parametrize("seed", range(2))
def test_chained_moves_equal_a_walk(spark, seed):
    import random
    from fleetlens.functions.flatten import chained_moves
    r = random.Random(seed)
    parts = ["/h1", "/h2", "/a", "/b", "/z", "/h1/h1", "/h2/h1"]
    spots = {("top" + "".join(r.choice(parts) for _ in range(r.randrange(0, 5))), f"f{r.randrange(3)}") for _ in range(120)}
    files = [(n, d, f) for n, (d, f) in enumerate(sorted(spots))]
    df = spark.createDataFrame(files, "n long, dir string, file string")
    got = chained_moves(df, "dir", "file", ["/h1", "/h2"])
    want = _walked(files, ["/h1", "/h2"])
    assert {row["n"]: (row["final"], row["moves"], row["replaced_at"]) for row in got.collect()} == want and got.count() == len(files)
    assert max(m for _, m, _ in want.values()) > 1 and any(w[0] is None for w in want.values())


def test_chained_moves_of_nothing(spark):
    from fleetlens.functions.flatten import chained_moves
    none = spark.createDataFrame([], "dir string, file string, final string")
    got = chained_moves(none, "dir", "file", ["h"])
    assert got.count() == 0 and got.columns[:2] == ["dir", "file"]
