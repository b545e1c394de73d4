"""S2 file catalog, S3 statistics ingest, S4 fail-if-exists sink."""

import contextlib
import io
import os

import pytest

from helpers import rows
from fleetlens.sources.catalog import file_catalog, list_tree
from fleetlens.sources.sinks import write_new
from fleetlens.sources.stats import read_stats
from specfix import write_text


def _explain(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_file_catalog_lists_without_content(spark, tmp):
    write_text(os.path.join(tmp, "r1", "local"), "x.csv", "a,b\n1,2\n")
    write_text(os.path.join(tmp, "r1", "u@h"), "y.csv", "a\n3\n")
    cat = file_catalog(spark, tmp)
    assert rows(cat, "rel_path", "length") == [("r1/local/x.csv", 8), ("r1/u@h/y.csv", 4)]
    plan = _explain(cat)
    read_schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln]
    assert read_schema and all("content" not in ln for ln in read_schema)


def test_tree_listed_in_tasks_equals_the_catalog(spark, tmp):
    root = os.path.join(tmp, "a tree")
    for i in range(60):
        write_text(os.path.join(root, f"r{i % 5}", f"u {i % 7}%20@é", *["deep"] * (i % 4)), f"f {i}+%41.{'csv' if i % 3 else 'log'}", "x" * (i + 1))
    os.makedirs(os.path.join(root, "empty", "folder"))
    cols = ("path", "local_path", "rel_path", "length", "mtime")
    assert rows(list_tree(spark, root), *cols) == rows(file_catalog(spark, root), *cols)
    assert rows(list_tree(spark, f"file://{root}/", glob="*.csv"), *cols) == rows(file_catalog(spark, root, glob="*.csv"), *cols)
    assert list_tree(spark, root, glob="f 1?+*[!c]sv").count() == 0
    # what Spark's listing leaves out: empty files, names with _ or . in front
    write_text(os.path.join(root, "_run", ".x"), "_y", "")
    os.symlink(root, os.path.join(root, "r0", "loop"))
    more = rows(list_tree(spark, root).where("length = 0"), "rel_path", "length")
    assert more == [("_run/.x/_y", 0)] and list_tree(spark, root).count() == 61
    assert list_tree(spark, os.path.join(root, "empty")).count() == 0
    with pytest.raises(Exception, match="a tree/none"):
        list_tree(spark, os.path.join(root, "none"))


def test_read_stats_lineage_and_merge_by_name(spark, tmp):
    write_text(os.path.join(tmp, "_rtt20_loss0", "u@h1"), "2-stats-snd.csv", "time,sent\n1,10\n2,20\n")
    write_text(os.path.join(tmp, "_rtt20_loss0", "u@h2"), "1-stats-rcv.csv", "time,recv,lost\n1,9,1\n")
    df = read_stats(spark, tmp, globs=("*-snd.csv", "*-rcv.csv"))
    assert set(df.columns) >= {"run", "origin", "file", "time", "sent", "recv", "lost"}
    assert rows(df, "run", "origin", "file", "time", "sent", "recv") == [
        ("_rtt20_loss0", "u@h1", "2-stats-snd.csv", 1, 10, None),
        ("_rtt20_loss0", "u@h1", "2-stats-snd.csv", 2, 20, None),
        ("_rtt20_loss0", "u@h2", "1-stats-rcv.csv", 1, None, 9)]


def test_read_stats_of_thousands_of_kinds(spark, tmp):
    """2,000 headers, columns in any order, quoted values and a file without rows, in one scan."""
    want = []
    for i in range(2000):
        names = ["time", f"own{i}", "note"] if i % 2 else ["note", "time", f"own{i}"]
        row = {"time": str(i), f"own{i}": "x", "note": f'"a, ""{i}"""'}
        write_text(os.path.join(tmp, f"r{i % 7}", "u@h"), f"{i}.csv", ",".join(names) + "\n" + ("" if i % 50 == 0 else ",".join(row[n] for n in names) + "\n"))
        if i % 50:
            want.append((f"r{i % 7}", i, f'a, "{i}"', "x" if i == 77 else None))
    df = read_stats(spark, tmp, schema="time INT, note STRING, own77 STRING, absent DATE", escape='"')
    assert rows(df, "run", "time", "note", "own77") == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert df.schema.simpleString() == "struct<run:string,origin:string,file:string,time:int,note:string,own77:string,absent:date>"
    assert sum("FileScan csv" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines()) == 1


def test_read_stats_infers_over_all_files(spark, tmp):
    write_text(os.path.join(tmp, "r1", "h"), "a.csv", "n,d,big,t,flag,word\n1,1,1,2020-01-01 00:00:00,true,x\n")
    write_text(os.path.join(tmp, "r1", "h"), "b.csv", "d,n,big,t,flag,word,none\n0.5,2,3000000000,2020-01-02,false,7,\n,,,,,,\n")
    types = dict(read_stats(spark, tmp).dtypes)
    assert [types[c] for c in ("n", "d", "big", "t", "flag", "word", "none")] == ["int", "double", "bigint", "timestamp", "boolean", "string", "string"]
    assert rows(read_stats(spark, tmp), "n", "d", "big", "word") == [(1, 1.0, 1, "x"), (2, 0.5, 3000000000, "7"), (None, None, None, None)]


def test_of_two_writers_one_is_refused(spark, tmp):
    import threading
    from pyspark.sql import functions as F
    from fleetlens.sources.sinks import Claimed
    for n in range(3):
        out, told = os.path.join(tmp, f"deep/out{n}"), []

        def write():
            try:
                write_new(spark.range(1000), out)
                told.append("wrote")
            except Claimed:
                told.append("claimed")
            except Exception as e:
                told.append("exists" if "PATH_ALREADY_EXISTS" in str(e) else repr(e))

        threads = [threading.Thread(target=write) for _ in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert told.count("wrote") == 1 and set(told) <= {"wrote", "claimed", "exists"}, told
        assert spark.read.parquet(out).count() == 1000 and not os.path.exists(os.path.join(tmp, f"deep/.out{n}.claim"))
    with pytest.raises(Exception):  # a failed write gives its claim back
        write_new(spark.range(3).select(F.raise_error(F.lit("no"))), os.path.join(tmp, "failed"))
    assert not os.path.exists(os.path.join(tmp, ".failed.claim"))


def test_write_new_refuses_existing(spark, tmp):
    out = os.path.join(tmp, "out")
    df = spark.range(3)
    write_new(df, out)
    with pytest.raises(Exception):
        write_new(spark.range(5), out)
    assert spark.read.parquet(out).count() == 3


def test_collected_tree_flatten(spark, tmp):
    """Collected layout with underscore run folders: catalog at depth 3, then
    the flatten plan moves files out of the host folders."""
    from pyspark.sql import functions as F
    from fleetlens.functions.flatten import flatten_paths
    run = os.path.join(tmp, "_rtt20_loss0_sendrate10_latency10")
    write_text(os.path.join(run, "user@192.0.2.51"), "2-stats-snd.csv", "a\n1\n")
    write_text(os.path.join(run, "user@192.0.2.52"), "1-stats-rcv.csv", "a\n1\n")
    write_text(os.path.join(tmp, "_rtt20_loss1", "user@192.0.2.51"), "2-stats-snd.csv", "a\n1\n")
    cat = file_catalog(spark, tmp, depth=3)
    assert cat.count() == 3
    files = cat.select(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("dir"),
                       F.substring_index("rel_path", "/", -1).alias("file"))
    plan = flatten_paths(files, "dir", "file", ["user@192.0.2.51", "user@192.0.2.52"])
    assert rows(plan, "src", "dst", "kept") == [
        ("_rtt20_loss0_sendrate10_latency10/user@192.0.2.51/2-stats-snd.csv",
         "_rtt20_loss0_sendrate10_latency10/2-stats-snd.csv", True),
        ("_rtt20_loss0_sendrate10_latency10/user@192.0.2.52/1-stats-rcv.csv",
         "_rtt20_loss0_sendrate10_latency10/1-stats-rcv.csv", True),
        ("_rtt20_loss1/user@192.0.2.51/2-stats-snd.csv", "_rtt20_loss1/2-stats-snd.csv", True)]
