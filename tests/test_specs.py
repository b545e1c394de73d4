"""Spec flow: S1, P1, P3, P4, X2, X3 and J1 on spec fixtures.

Command goldens follow the documented command examples and the unit-test
goldens for URI, subcommand and quoting rules."""

import os

from pyspark.sql import functions as F

from helpers import rows
from fleetlens.fixed import CAPTURE_TYPE, TRANSMIT_TYPE, URI_SCHEME
from fleetlens.functions.artifacts import expected_artifacts
from fleetlens.operators.reconcile import reconcile
from fleetlens.operators.specs import command_manifest, spec_tasks, validate_tasks
from fleetlens.sources.catalog import file_catalog
from fleetlens.sources.specs import read_specs
from specfix import SPEC_BASIC, capture, spec, task, transmit, write_spec, write_text


def _tasks(spark, tmp, **specs):
    for name, s in specs.items():
        write_spec(tmp, f"{name}.json", s)
    return spec_tasks(read_specs(spark, os.path.join(tmp, "*.json")))


def _commands(spark, tmp, s):
    t = _tasks(spark, tmp, one=s)
    return {r["task"]: (r["argv"], r["command"]) for r in command_manifest(t).collect()}


def test_read_specs_one_row_per_file(spark, tmp):
    write_spec(tmp, "a.json", SPEC_BASIC)
    write_spec(tmp, "b.json", SPEC_BASIC)
    df = read_specs(spark, os.path.join(tmp, "*.json"))
    got = df.select("run", "stop_after", "malformed").collect()
    assert len(got) == 2
    assert all(r["run"].endswith(".json") and r["stop_after"] == 70 and not r["malformed"] for r in got)


def test_task_order_is_file_order(spark, tmp):
    s = spec({k: task(CAPTURE_TYPE, capture(trace=f"/t/{k}.pcapng")) for k in ["10", "2", "1"]})
    t = _tasks(spark, tmp, order=s)
    assert rows(t, "pos", "task", "prefix") == [(0, "10", "10"), (1, "2", "2"), (2, "1", "1")]


def test_integer_port_is_text(spark, tmp):
    s = spec({"1": task(CAPTURE_TYPE, capture(port=5811))})
    t = _tasks(spark, tmp, p=s)
    assert t.select("obj_config.port").first()[0] == "5811"


def test_command_goldens(spark, tmp):
    cmds = _commands(spark, tmp, SPEC_BASIC)
    argv1, text1 = cmds["1"]
    assert argv1 == ["capbin", "-i", "eth7", "-f", "udp port 5811", "-s", "1500", "-w",
                     "_tmp/left-trace.pcapng"]
    assert text1 == 'capbin -i eth7 -f "udp port 5811" -s 1500 -w _tmp/left-trace.pcapng'
    _, text2 = cmds["2"]
    assert text2 == (f'bin/xmit receive "{URI_SCHEME}:5811?rcvbuf=64000000&sndbuf=64000000'
                     '&latency=400" --msgsize 1250 --statsfile /data/exp/right-numbers.csv '
                     '--statsfreq 1s --enable-metrics --metricsfile /data/exp/rcv-metrics.csv')


def test_uri_subcommand_and_options(spark, tmp):
    s = spec({
        "3": task(TRANSMIT_TYPE, transmit("snd", host="127.0.0.1")),
        "4": task(TRANSMIT_TYPE, transmit("snd", host="127.0.0.1", attrs={
            "transtype": "live", "rcvbuf": "64000000", "sndbuf": "64000000"})),
        "5": task(TRANSMIT_TYPE, transmit("snd", host="127.0.0.1", options={
            "--msgsize": "1250", "--sendrate": "15Mbps", "--duration": "10s"})),
        "6": task(TRANSMIT_TYPE, transmit("rcv", host="")),
    })
    c = _commands(spark, tmp, s)
    u = URI_SCHEME
    assert c["3"] == (["bin/xmit", "generate", f"{u}127.0.0.1:5811"],
                      f'bin/xmit generate "{u}127.0.0.1:5811"')
    assert c["4"][0] == ["bin/xmit", "generate",
                         f"{u}127.0.0.1:5811?transtype=live&rcvbuf=64000000&sndbuf=64000000"]
    assert c["5"][1] == (f'bin/xmit generate "{u}127.0.0.1:5811" --msgsize 1250 '
                         '--sendrate 15Mbps --duration 10s')
    assert c["6"] == (["bin/xmit", "receive", f"{u}:5811"], f'bin/xmit receive "{u}:5811"')


def test_null_absent_empty(spark, tmp):
    s = spec({
        "n1": task(TRANSMIT_TYPE, transmit("snd", host=None, attrs={},
                                           options={"--a": None, "--b": "", "--c": "0"})),
        "n2": task(TRANSMIT_TYPE, transmit("snd")),
    })
    # host present but null: the json fixture writes it explicitly
    s["tasks"]["n1"]["obj_config"]["host"] = None
    c = _commands(spark, tmp, s)
    u = URI_SCHEME
    assert c["n1"][0] == ["bin/xmit", "generate", f"{u}None:5811?", "--a", "--b", "--c", "0"]
    assert c["n2"][0] == ["bin/xmit", "generate", f"{u}:5811"]


def test_validation_rejects_and_warnings(spark, tmp):
    bad_cap = capture()
    del bad_cap["tracefile_path"]
    s = spec({
        "u1": task("unknown-app", {"path": "x"}),
        "u2": dict(task(CAPTURE_TYPE, capture()), runner_type="other-runner"),
        "m1": task(CAPTURE_TYPE, bad_cap),
        "m2": task(TRANSMIT_TYPE, transmit("rcv"), runner="remote", user="tester", host=None),
        "w1": task(TRANSMIT_TYPE, transmit("fwd")),
        "ok": task(CAPTURE_TYPE, capture()),
    })
    del s["tasks"]["m2"]["runner_config"]["host"]
    acc, rej = validate_tasks(spark, _tasks(spark, tmp, bad=s))
    assert rows(rej, "task", "reason") == [
        ("m1", "missing_key:tracefile_path"), ("m2", "missing_key:host"),
        ("u1", "unknown_type:unknown-app"), ("u2", "unknown_type:other-runner")]
    assert rows(acc, "task", "warning") == [("ok", None), ("w1", "no_subcommand:fwd")]


def test_expected_artifacts_and_destinations(spark, tmp):
    a = expected_artifacts(_tasks(spark, tmp, basic=SPEC_BASIC))
    assert rows(a, "task", "artifact_pos", "role", "destination") == [
        ("1", 0, "trace", "_results/local/left-trace.pcapng"),
        ("2", 0, "stats", "_results/tester@192.0.2.10/right-numbers.csv"),
        ("2", 1, "metrics", "_results/tester@192.0.2.10/rcv-metrics.csv")]


def test_spec_to_reconcile_end_to_end(spark, tmp):
    src = os.path.join(tmp, "src")
    for d in ["a", "b", "c"]:
        write_text(os.path.join(src, d), "stats.csv", "t,v\n1,2\n")
    s = spec({
        "1": task(TRANSMIT_TYPE, transmit("rcv", options={
            "--statsfile": f"{src}/a/stats.csv", "--metricsfile": f"{src}/a/metrics.csv"})),
        "2": task(TRANSMIT_TYPE, transmit("snd", options={"--statsfile": f"{src}/b/stats.csv"})),
        "3": task(TRANSMIT_TYPE, transmit("snd", options={"--statsfile": f"{src}/c/stats.csv"}),
                  runner="remote", user="tester", host="192.0.2.11"),
    })
    specs_dir = os.path.join(tmp, "specs")
    write_spec(specs_dir, "clash.json", s)
    tasks = spec_tasks(read_specs(spark, os.path.join(specs_dir, "*.json")))
    expected = expected_artifacts(tasks)
    found = file_catalog(spark, src).select(F.col("local_path").alias("path"))
    r = reconcile(expected, found, on=["path"], destination="destination",
                  order=["pos", "artifact_pos"])
    assert rows(r, "task", "role", "status") == [
        ("1", "metrics", "missing"), ("1", "stats", "collected"),
        ("2", "stats", "conflict"), ("3", "stats", "collected")]


def test_spec_timeline(spark, tmp):
    from fleetlens.operators.specs import spec_timeline
    s = spec({
        "1": task(CAPTURE_TYPE, capture(), sleep_after_start=2),
        "2": task(TRANSMIT_TYPE, transmit("rcv"), runner="remote", user="u", host="192.0.2.1",
                  sleep_after_stop=3, stop_order=1),
        "3": task(TRANSMIT_TYPE, transmit("snd"), sleep_after_start=1, sleep_after_stop=4),
    }, stop_after=70)
    t = _tasks(spark, tmp, tl=s)
    # starts: 1 at 0 (5+2), 2 at 7 (11), 3 at 18 (5+1); run end 24 + 70 = 94
    # parity stops in reverse: 3 at 94 (+4), 2 at 98 (+3), 1 at 101
    assert rows(spec_timeline(t), "task", "start_rank", "stop_rank", "start_at", "ready_at", "stop_at") == [
        ("1", 1, 3, 0, 5, 101), ("2", 2, 2, 7, 18, 98), ("3", 3, 1, 18, 23, 94)]
    # honouring stop_order: task 2 first, then the rest in reverse (3, 1)
    assert rows(spec_timeline(t, honor_stop_order=True), "task", "stop_rank", "stop_at") == [
        ("1", 3, 101), ("2", 1, 94), ("3", 2, 97)]


def test_run_of_a_line_is_the_specs_own_path(spark, tmp):
    """A runner's results path, also ahead of the spec's own, is not the run."""
    from fleetlens.sources.specs import read_specs
    task = '{"1": {"obj_type": "x", "runner_type": "y", "runner_config": {"collect_results_path": "nested/x"}}}'
    lines = ['{"tasks": ' + task + ', "collect_results_path": "results/e1"}', '{"collect_results_path": "results/e2", "tasks": ' + task + '}',
             '{"tasks": ' + task + '}', '{"collect_results_path": "results/e3", "tasks": {"1"']
    with open(os.path.join(tmp, "specs.txt"), "w") as f:
        f.write("\n".join(lines) + "\n")
    got = [r["run"] for r in read_specs(spark, os.path.join(tmp, "specs.txt"), json_lines=True).collect()]
    assert got[:2] == ["results/e1", "results/e2"] and got[2].startswith("line:") and got[3] == "results/e3"


def test_prechecks_are_those_at_the_collect(spark):
    from fleetlens.operators.specs import collect_prechecks, with_prechecks
    log = [("a", "start"), ("a", "stop"), ("a", "collect"), ("b", "start"), ("b", "collect"), ("b", "stop"), ("c", "collect"), ("c", "start"), ("c", "stop"),
           ("d", "collect"), ("d", "start"), ("d", "stop"), ("d", "collect"), ("e", "start")]
    ev = spark.createDataFrame([(k, i, a) for i, (k, a) in enumerate(log)], "task string, at int, what string")
    expected = spark.createDataFrame([(k,) for k in "abcdef"], "task string")
    from pyspark.sql import functions as F
    for hot in (1, 1000):
        got = with_prechecks(expected, collect_prechecks(ev, ["task"], ["at"], F.col("what"), hot_rows=hot), ["task"])
        assert rows(got) == [("a", None), ("b", "not_stopped"), ("c", "not_started"), ("d", None), ("e", "not_started"), ("f", "not_started")]
