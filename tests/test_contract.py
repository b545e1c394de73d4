"""Driver contract: bench.py prints one JSON line; entry has a stable schema."""

import json
import os
import subprocess
import sys

from helpers import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_REPEAT="1", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "failure_rollup"],
                         capture_output=True, text=True, env=env, timeout=600, check=True)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(rec)
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"failure_rollup"}


def test_entry_schema(spark):
    import __spark_entry__ as E
    assert E.entry(spark).schema.simpleString() == "struct<status:string,n_artifacts:bigint>"
