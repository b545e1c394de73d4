"""Edges of paths, commands, sweeps, specs, statistics and periodic sums."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import rows
from specfix import write_text


def col(spark, value, expr, t="string"):
    return spark.createDataFrame([(value,)], f"v {t}").select(expr.alias("x")).first()["x"]


def test_parents(spark):
    from fleetlens.functions.paths import join_path, parent_dir
    want = {"t.pcap": ".", "/t": "/", "/a/t": "/a", "a/t": "a", "a/b/": "a/b", None: None}
    assert {v: col(spark, v, parent_dir("v")) for v in want} == want
    assert col(spark, None, join_path(F.lit("res"), "v", F.lit("b"))) is None


def test_null_origin_gives_no_destination(spark):
    from fleetlens.functions.artifacts import origin_of
    df = spark.createDataFrame([("local-runner", None, None), ("remote-runner", "u", "h"), ("remote-runner", None, "h"), ("other", "u", "h")],
                               "t string, u string, h string")
    assert [r[0] for r in df.select(origin_of("t", "u", "h")).collect()] == ["local", "u@h", None, None]


def test_capture_text_keeps_every_element(spark):
    from fleetlens.functions.commands import capture_text
    argv = [f"a{i}" for i in range(12)] + ["two words", None]
    assert col(spark, argv, capture_text("v"), "array<string>") == " ".join(argv[:12]) + ' "two words" None'


def test_sums_of_large_and_small_values(spark):
    from fleetlens.operators.periodic import periodic_stats
    ev = spark.range(1000).select(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("ts"), F.lit("k").alias("k"),
                                  F.when(F.col("id") < 10, F.lit(2.5e12)).otherwise(F.lit(0.004)).alias("v"), "id")
    got = periodic_stats(ev, "ts", "1 hour", ["k"], "v", tiebreak="id").first()
    assert float(got["sum_value"]) == pytest.approx(2.5e13 + 990 * 0.004, abs=1e-6)


def test_long_axes_and_bad_values(spark, monkeypatch):
    import fleetlens.operators.sweep as S
    long = spark.range(200_000).select(F.col("id").cast("string"))
    two = spark.createDataFrame([("x",), ("y",)], "b string")
    g = S.sweep_grid(spark, {"a": long, "b": two})
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert g.count() == 400_000 and g.select("run").distinct().count() == 400_000
    with pytest.raises(ValueError):
        S.sweep_grid(spark, {"a": long, "b": two}, max_runs=1000)
    for bad in ([(None,)], [("1_b2",)]):
        with pytest.raises(Exception, match="sweep axis"):
            S.sweep_grid(spark, {"a": spark.createDataFrame(bad, "a string"), "b": two}).collect()
    marked = S.sweep_grid(spark, {"a+": two, "c": two.select(F.col("b").alias("z"))})
    assert sorted(map(tuple, marked.select(*S.decode_run(F.col("run"), ["a+", "c"])).collect())) == [(x, y) for x in "xy" for y in "xy"]


def test_every_spec_file_leaves_a_row(spark, tmp):
    from fleetlens.operators.specs import spec_rejects
    from fleetlens.sources.specs import read_specs
    good = '{"collect_results_path": "r", "tasks": {"1": {"obj_type": "x"}}}'
    for name, text in (("good one.json", good), ("cut.json", good[:-4]), ("wrong.json", '{"a" 1}'), ("none.json", '{"collect_results_path": "r"}'),
                       ("empty.json", ""), ("blank.json", "  "), ("notasks.json", '{"tasks": {}}')):
        write_text(tmp, name, text)
    got = {os.path.basename(r["run"]): r["error"] for r in read_specs(spark, f"{tmp}/*.json").collect()}
    assert got == {"good one.json": None, "cut.json": "invalid_json", "wrong.json": "invalid_json", "none.json": "no_tasks",
                   "empty.json": "empty", "blank.json": "empty", "notasks.json": "no_tasks"}
    assert spec_rejects(read_specs(spark, f"{tmp}/*.json")).count() == 6


def test_null_role_warns(spark, tmp):
    from fleetlens.operators.specs import spec_tasks, validate_tasks
    from fleetlens.sources.specs import read_specs
    cfg = '{"type": null, "path": "p", "port": "1"}'
    write_text(tmp, "s.json", '{"tasks": {"1": {"obj_type": "srt-xtransmit", "obj_config": %s, "runner_type": "local-runner", "runner_config": {}}}}' % cfg)
    accepted, _ = validate_tasks(spark, spec_tasks(read_specs(spark, f"{tmp}/*.json")))
    assert accepted.first()["warning"] == "no_subcommand:null"


@pytest.mark.parametrize("schema", [None, "t int, v int"])
def test_statistics_are_merged_by_name(spark, tmp, schema):
    from fleetlens.sources.stats import read_stats
    root = os.path.join(tmp, "a.b (1)")
    write_text(os.path.join(root, "r 1+x", "h"), "a.csv", "t,v\n1,10\n")
    write_text(os.path.join(root, "r2", "h"), "b.csv", "v,t,w\n20,2,5\n")
    got = read_stats(spark, root, schema=schema)
    assert rows(got, "run", "origin", "file", "t", "v") == [("r 1+x", "h", "a.csv", 1, 10), ("r2", "h", "b.csv", 2, 20)]


def test_shared_folder_must_be_named_on_a_cluster():
    from fleetlens.session import ensure_checkpoint_dir

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
