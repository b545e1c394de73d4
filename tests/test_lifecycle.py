"""T1-T5 on a hand-written lifecycle log (times in seconds)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from helpers import rows
from fleetlens.operators.lifecycle import (current_status, launch_probe, lifecycle_check,
                                           stop_escalation)

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, kind STRING, value DOUBLE"
ORDER = ["ts", "event_id"]


def _log(spark, items):
    data = [(i, u, T0 + dt.timedelta(seconds=s), k, v) for i, (u, s, k, v) in enumerate(items)]
    return spark.createDataFrame(data, SCHEMA)


def actions():
    k = F.col("kind")
    return F.when(k == "start", "start").when(k == "stop", "stop").when(k == "collect", "collect")

VERDICT_LOG = [
    (1, 0, "start", 0.0), (1, 10, "stop", 0.0), (1, 20, "collect", 0.0),      # normal run
    (2, 0, "start", 0.0), (2, 5, "start", 0.0),                             # double start
    (3, 0, "stop", 0.0), (3, 1, "start", 0.0), (3, 2, "stop", 0.0), (3, 3, "stop", 0.0),
    (4, 0, "start", 0.0), (4, 1, "collect", 0.0),                           # collect while running
    (5, 0, "collect", 0.0),                                                 # never started
]
EXPECTED = [
    (0, "start", "ok"), (1, "stop", "ok"), (2, "collect", "ok"),
    (3, "start", "ok"), (4, "start", "already_started"),
    (5, "stop", "not_started"), (6, "start", "ok"), (7, "stop", "ok"), (8, "stop", "noop"),
    (9, "start", "ok"), (10, "collect", "still_running"),
    (11, "collect", "not_started"),
]


def test_lifecycle_check(spark):
    ev = _log(spark, VERDICT_LOG)
    out = lifecycle_check(ev, ["user_id"], ORDER, actions())
    assert rows(out, "event_id", "action", "verdict") == sorted(EXPECTED, key=lambda t: str(t[0]))


def test_failed_stop_leaves_task_running(spark):
    ev = _log(spark, [(1, 0, "start", 0.0), (1, 1, "stop", 0.0), (1, 2, "collect", 0.0),
                      (1, 3, "stop", 1.0), (1, 4, "collect", 0.0)])
    out = lifecycle_check(ev, ["user_id"], ORDER, actions(), stop_ok=F.col("value") > 0)
    assert [r["verdict"] for r in out.orderBy("event_id").collect()] == [
        "ok", "failed", "still_running", "ok", "ok"]


def test_current_status(spark):
    ev = _log(spark, [(1, 0, "start", 0.0), (1, 9, "exit", 3.0),
                      (2, 0, "start", 0.0),
                      (3, 0, "start", 0.0), (3, 4, "exit", 0.0), (3, 5, "start", 0.0)])
    tasks = spark.createDataFrame([(i,) for i in [1, 2, 3, 4]], "user_id BIGINT")
    out = current_status(ev, ["user_id"], ORDER, F.col("kind") == "start",
                         F.col("kind") == "exit", F.col("value"), tasks=tasks)
    assert rows(out, "user_id", "status", "returncode") == [
        (1, "idle", 3), (2, "running", None), (3, "running", None), (4, "idle", None)]


def test_launch_probe_grace(spark):
    ev = _log(spark, [(1, 0, "start", 0.0), (1, 2, "exit", 0.0),     # exit inside grace, code 0
                      (2, 0, "start", 0.0), (2, 10, "exit", 1.0),    # exit after grace
                      (3, 0, "start", 0.0)])                          # never exits
    ev = ev.withColumn("rc", F.col("value").cast("int"))
    out = launch_probe(ev, ["user_id"], ORDER, F.col("kind") == "start",
                       F.col("kind") == "exit", "rc", grace_s=5)
    assert rows(out, "user_id", "launched", "returncode") == [
        (1, False, 0), (2, True, None), (3, True, None)]


def test_stop_escalation_buckets(spark):
    ev = _log(spark, [(1, 0, "stop", 0.0), (1, 2, "exit", 0.0),
                      (2, 0, "stop", 0.0), (2, 3.5, "exit", 0.0),
                      (3, 0, "stop", 0.0),
                      (4, 0, "stop", 0.0), (4, 5, "exit", 0.0),
                      (5, 0, "stop", 1.0)])
    out = stop_escalation(ev, ["user_id"], ORDER, F.col("kind") == "stop",
                          F.col("kind") == "exit", already_idle=F.col("value") > 0)
    assert rows(out, "user_id", "outcome") == [
        (1, "terminated"), (2, "killed"), (3, "not_stopped"), (4, "not_stopped"),
        (5, "already_exited")]


def test_stream_equals_batch(spark, tmp):
    from fleetlens.streaming.lifecycle import lifecycle_stream
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    ev = _log(spark, VERDICT_LOG)
    folder = os.path.join(tmp, "events")
    ev.write.parquet(folder)
    s = file_stream(spark, folder, ev.schema)
    got = drain_to_parquet(spark, lifecycle_stream(s, actions(), lateness="0 seconds"), "t5-test")
    want = lifecycle_check(ev, ["user_id"], ORDER, actions())
    assert rows(got, "event_id", "action", "verdict") == rows(want, "event_id", "action", "verdict")


def test_periodic_stream_emits_closed_windows(spark, tmp):
    from fleetlens.operators.periodic import periodic_stats
    from fleetlens.streaming.periodic import periodic_stats_stream
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    ev = _log(spark, [(1, s, "x", float(s)) for s in range(0, 4 * 3600, 600)])
    folder = os.path.join(tmp, "ev")
    ev.write.parquet(folder)
    s = file_stream(spark, folder, ev.schema)
    got = drain_to_parquet(spark, periodic_stats_stream(s, "ts", "1 hour", ["kind"], "value",
                                                        lateness="30 minutes"), "t6-test")
    batch = periodic_stats(ev, "ts", "1 hour", ["kind"], "value")
    # max ts 03:50 -> watermark 03:20: hours 0, 1, 2 are closed, hour 3 is open
    closed = batch.filter(F.col("window_end") <= F.lit(T0 + dt.timedelta(hours=3, minutes=20)))
    cols = ["window_start", "n", "sum_value", "first_value", "last_value"]
    assert rows(got, *cols) == rows(closed, *cols)
    assert got.count() == 3


def test_stream_state_across_micro_batches(spark, tmp):
    """The same log split into time slices, one file per trigger: flags must
    carry over in state from batch to batch."""
    from fleetlens.streaming.lifecycle import lifecycle_stream
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    ev = _log(spark, VERDICT_LOG)
    folder = os.path.join(tmp, "sliced")
    for lo, hi in [(0, 1), (1, 3), (3, 6), (6, 100)]:
        (ev.filter((F.col("ts") >= F.lit(T0 + dt.timedelta(seconds=lo)))
                   & (F.col("ts") < F.lit(T0 + dt.timedelta(seconds=hi))))
           .coalesce(1).write.mode("append").parquet(folder))
    s = file_stream(spark, folder, ev.schema, max_files_per_trigger=1)
    got = drain_to_parquet(spark, lifecycle_stream(s, actions(), lateness="0 seconds"), "t5-sliced")
    want = lifecycle_check(ev, ["user_id"], ORDER, actions())
    assert rows(got, "event_id", "action", "verdict") == rows(want, "event_id", "action", "verdict")


def test_monitor_deadlines_across_micro_batches(spark, tmp):
    from fleetlens.streaming.monitor import lifecycle_monitor
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    log = [(1, 0, "start", 0.0), (1, 2, "exit", 0.0),        # exit inside grace, code 0
           (2, 0, "start", 0.0), (2, 10, "exit", 1.0),       # exit after grace
           (3, 0, "start", 0.0),                             # never exits: settled by watermark
           (4, 0, "stop", 0.0), (4, 2, "exit", 0.0),         # terminated
           (5, 0, "stop", 0.0), (5, 3.5, "exit", 0.0),       # killed
           (6, 0, "stop", 0.0),                              # never exits
           (7, 100, "collect", 0.0)]                         # moves the watermark
    ev = _log(spark, log)
    folder = os.path.join(tmp, "mon")
    for lo, hi in [(0, 1), (1, 3), (3, 6), (6, 200)]:
        (ev.filter((F.col("ts") >= F.lit(T0 + dt.timedelta(seconds=lo)))
                   & (F.col("ts") < F.lit(T0 + dt.timedelta(seconds=hi))))
           .coalesce(1).write.mode("append").parquet(folder))
    s = file_stream(spark, folder, ev.schema, max_files_per_trigger=1)
    exit_ = F.col("kind") == "exit"
    m = lifecycle_monitor(s, actions(), launch_exit=exit_, stop_exit=exit_,
                          returncode=F.col("value"), grace_s=5, lateness="0 seconds")
    got = drain_to_parquet(spark, m, "t5-monitor")
    assert rows(got.filter("kind IN ('launch', 'stop')"), "user_id", "kind", "outcome",
                "returncode") == [
        (1, "launch", "launch_failed", 0), (2, "launch", "launched", None),
        (3, "launch", "launched", None), (4, "stop", "terminated", None),
        (5, "stop", "killed", None), (6, "stop", "not_stopped", None)]
    verdicts = lifecycle_check(ev, ["user_id"], ORDER, actions())
    assert rows(got.filter("kind = 'verdict'"), "event_id", "outcome") == \
        rows(verdicts, "event_id", "verdict")
    # the latest status row of each key equals the batch current status
    from pyspark.sql import Window
    last = (got.filter("kind = 'status'")
               .withColumn("r", F.row_number().over(Window.partitionBy("user_id")
                                                    .orderBy(F.col("event_id").desc())))
               .filter("r = 1"))
    status = current_status(ev, ["user_id"], ORDER, F.col("kind") == "start",
                            F.col("kind") == "exit", F.col("value"))
    keys = [r["user_id"] for r in ev.select("user_id").distinct().collect()]
    assert rows(last, "user_id", "outcome", "returncode") == \
        rows(spark.createDataFrame([(k,) for k in keys], "user_id bigint")
             .join(status, "user_id", "left")
             .select("user_id", F.coalesce("status", F.lit("idle")).alias("status"), "returncode"))


def test_periodic_stream_drops_late_rows(spark, tmp):
    """Spark filters late rows against the previous micro-batch's watermark:
    a row arriving a batch after the watermark passed its window is dropped,
    and the window was emitted without it."""
    import time
    from fleetlens.streaming.periodic import periodic_stats_stream
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    folder = os.path.join(tmp, "late")
    parts = [[(1, s, "x", 1.0) for s in range(0, 4 * 3600, 600)],     # 00:00 .. 03:50
             [(1, 6 * 3600, "x", 1.0)],                                # 06:00 moves the watermark
             [(1, 600, "x", 100.0)]]                                   # 00:10 arrives late
    for p in parts:
        _log(spark, p).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.2)                                                # file order = write order
    s = file_stream(spark, folder, _log(spark, parts[0]).schema, max_files_per_trigger=1)
    dropped = {}
    got = drain_to_parquet(spark, periodic_stats_stream(s, "ts", "1 hour", ["kind"], "value",
                                                        lateness="30 minutes"), "t6-late", dropped=dropped)
    assert dropped == {"late_rows": 1}     # and it is reported
    by_hour = {r["window_start"].hour: (r["n"], r["max_value"]) for r in got.collect()}
    assert by_hour[0] == (6, 1.0)          # the late 100.0 row did not get in
    assert set(by_hour) == {0, 1, 2, 3}    # 06:00 window still open at the end


def _in_parts(df, folder, parts):
    """One file for each list of row numbers, in this order."""
    import time
    from pyspark.sql import functions as F
    for ids in parts:
        df.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their times


def test_events_out_of_order_are_judged_in_order(spark, tmp):
    """Slices that mix earlier and later events, within the lateness, give the batch verdicts and outcomes."""
    import random
    from fleetlens.streaming.monitor import lifecycle_monitor
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    rnd = random.Random(11)
    log = [(rnd.randrange(4), 10.0 * i + rnd.random(), rnd.choice(["start", "stop", "collect", "exit", "exit"]), float(rnd.randrange(3)))
           for i in range(60)] + [(9, 10_000.0, "collect", 0.0)]  # the last one moves the watermark past all others
    ev = _log(spark, log).withColumn("unit", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    order = list(range(60))
    mixed = [order[i:i + 20] for i in range(0, 60, 20)]
    for a, b in ((0, 1), (1, 2)):  # half of each slice comes with the next
        mixed[a], mixed[b] = mixed[a][::2] + mixed[b][1::2], mixed[a][1::2] + mixed[b][::2]
    folder = os.path.join(tmp, "mixed")
    first = ev.agg(F.min("event_id")).first()[0]
    _in_parts(ev, folder, [[first + i for i in p] for p in (*mixed, [60])])
    s = file_stream(spark, folder, ev.schema, max_files_per_trigger=1)
    exit_ = F.col("kind") == "exit"
    m = lifecycle_monitor(s, actions(), exit_, exit_, F.col("value"), grace_s=15, term_s=10, kill_s=10, key=["user_id", "unit"], lateness="30 minutes")
    got = drain_to_parquet(spark, m, "t5-mixed").filter("user_id < 9").cache()
    ev = ev.filter("user_id < 9")
    assert got.filter("unit <> concat('u', user_id)").count() == 0
    assert rows(got.filter("kind = 'verdict'"), "event_id", "action", "outcome") == \
        rows(lifecycle_check(ev, ["user_id"], ORDER, actions()), "event_id", "action", "verdict")
    probes = launch_probe(ev.withColumn("rc", F.col("value").cast("int")), ["user_id"], ORDER, F.col("kind") == "start", exit_, "rc", grace_s=15)
    assert rows(got.filter("kind = 'launch'").select("event_id", (F.col("outcome") == "launched").alias("launched"), "returncode")) == \
        rows(probes.select("event_id", "launched", "returncode"))
    stops = stop_escalation(ev, ["user_id"], ORDER, F.col("kind") == "stop", exit_, term_s=10, kill_s=10)
    assert rows(got.filter("kind = 'stop'").select("event_id", "outcome")) == rows(stops.select("event_id", "outcome"))


def test_a_long_task_keeps_its_state(spark, tmp):
    from fleetlens.streaming.lifecycle import lifecycle_stream
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    day = 86_400
    ev = _log(spark, [(1, 0, "start", 0.0), (2, 5 * day, "start", 0.0), (1, 10 * day, "stop", 0.0), (2, 11 * day, "start", 0.0)])
    folder = os.path.join(tmp, "long")
    first = ev.agg(F.min("event_id")).first()[0]
    _in_parts(ev, folder, [[first + i] for i in range(4)])
    s = file_stream(spark, folder, ev.schema, max_files_per_trigger=1)
    got = drain_to_parquet(spark, lifecycle_stream(s, actions(), lateness="0 seconds"), "t5-long")
    assert rows(got, "user_id", "action", "verdict") == [(1, "start", "ok"), (1, "stop", "ok"), (2, "start", "already_started"), (2, "start", "ok")]


def test_streams_read_a_folder_of_parts_like_a_file(spark, tmp):
    import time
    from helpers import SF_SMALL
    from fleetlens.plans.catalog import q_lifecycle_stream, q_periodic_stats_stream
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    at = [r["ts"] for r in ev.select("ts").orderBy("ts").collect()]
    cuts = [at[len(at) // 3], at[2 * len(at) // 3]]
    folder = os.path.join(tmp, "sf", "events.parquet")
    for cond in (F.col("ts") < F.lit(cuts[0]), (F.col("ts") >= F.lit(cuts[0])) & (F.col("ts") < F.lit(cuts[1])), F.col("ts") >= F.lit(cuts[1])):
        ev.filter(cond).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    for q in (q_lifecycle_stream, q_periodic_stats_stream):
        one, parts = q(spark, SF_SMALL), q(spark, os.path.join(tmp, "sf"), max_files_per_trigger=1)
        assert rows(one) == rows(parts) and one.count() > 0


def test_a_stopped_drain_raises(spark, tmp):
    from fleetlens.streaming.lifecycle import lifecycle_stream
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    ev = _log(spark, VERDICT_LOG)
    folder = os.path.join(tmp, "slow")
    ev.write.parquet(folder)
    with pytest.raises(TimeoutError):
        drain_to_parquet(spark, lifecycle_stream(file_stream(spark, folder, ev.schema), actions()), "t5-slow", timeout_s=0.01)


def test_stream_plan_is_one_stateful_operator(spark):
    from helpers import SF_SMALL
    from fleetlens.plans.catalog import _action, _task_stream
    from fleetlens.streaming.lifecycle import lifecycle_stream
    plan = lifecycle_stream(_task_stream(spark, SF_SMALL), _action(), key=["user_id", "unit"])._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithStateInPySpark") == 1 and "EventTimeWatermark" in plan and "BatchEvalPython" not in plan


class _Value:
    def __init__(self, held):
        self.held, self.v = held, None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class _Map:
    def __init__(self, held):
        self.held, self.d = held, {}

    def keys(self):
        return iter(list(self.d))

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        return self.d[k]

    def updateValue(self, k, v):
        self.held.append(len(v[0]))
        self.d[k] = v

    def removeKey(self, k):
        del self.d[k]


class _Handle:
    """State of one key, in memory, with the sizes of all values written."""

    def __init__(self):
        self.sizes, self.timers = [], set()

    def getValueState(self, *a):
        return _Value(self.sizes)

    def getMapState(self, *a):
        return _Map(self.sizes)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_a_hot_key_has_no_large_state_value(spark):
    """150,000 rows of one key in one micro-batch, in any order: entries stay small, and outcomes equal a plain pass."""
    import random
    import pandas as pd
    import pyarrow as pa
    from fleetlens.streaming import monitor
    r, n = random.Random(8), 150_000
    events = [(i, r.randrange(10 ** 9) if i % 5 else 777, r.choices(["start", "stop", "collect", "exit"], [3, 3, 3, 1])[0]) for i in range(n)]
    types = pa.schema([("lm_id", pa.int64()), ("lm_us", pa.int64()), ("action", pa.string()), ("launch_exit", pa.bool_()), ("stop_exit", pa.bool_()),
                       ("rc", pa.int32()), ("stop_ok", pa.bool_())])
    grace, term, kill, end = 3_000, 2_000, 1_500, 2 * 10 ** 9
    m, h = monitor.Monitor(["k"], "event_id", types, grace, term, kill, None, True, True, leaf=1000), _Handle()
    m.init(h)

    def frames():
        for a in range(0, n, 10_000):
            part = events[a:a + 10_000]
            ex = [e[2] == "exit" for e in part]
            yield pd.DataFrame({"lm_id": [e[0] for e in part], "lm_us": [e[1] for e in part], "action": [None if x else e[2] for e, x in zip(part, ex)],
                                "launch_exit": ex, "stop_exit": ex, "rc": [e[0] % 3 if x else None for e, x in zip(part, ex)], "stop_ok": True})

    assert [len(f) for f in m._run(("k",), frames(), 0)] == []
    ties = sum(e[1] == 777 for e in events)
    largest = max(len(monitor._unpacked(v)) for v in m.leaves.d.values())
    assert largest == ties and sorted(len(monitor._unpacked(v)) for v in m.leaves.d.values())[-2] <= 1000
    assert len(h.timers) == 1
    h.sizes.clear()
    got = {}
    for wm in (100_000, 500_000, end // 1000):  # the watermark comes in steps
        for f in m._run(("k",), (), wm):
            assert len(f) <= max(ties, 1000)
            for e, k, o, rc in zip(f["event_id"], f["kind"], f["outcome"], f["returncode"]):
                if k != "status":
                    assert (k, e) not in got
                    got[k, e] = (o, None if rc is pd.NA else int(rc))
    assert not m.leaves.d and not any(x.d for x in m.open.values()) and max(h.sizes) < 60_000

    want, started, stopped, cur, open_ = {}, False, False, None, {"launch": [], "stop": []}
    for i, us, what in sorted(events, key=lambda e: (e[1], e[0])):
        if what == "exit":
            for j, t in open_["launch"]:
                want["launch", j] = ("launch_failed", i % 3) if us - t <= grace else ("launched", None)
            for j, t in open_["stop"]:
                want["stop", j] = ("terminated" if us - t <= term else "killed" if us - t <= term + kill else "not_stopped", None)
            open_, cur = {"launch": [], "stop": []}, "exit"
        elif what == "start":
            want["verdict", i] = ("already_started" if started else "ok", None)
            open_["launch"].append((i, us))
            started, cur = True, "start"
        elif what == "stop":
            want["verdict", i] = ("not_started" if not started else "noop" if stopped else "ok", None)
            stopped = stopped or started
            if cur == "exit":
                want["stop", i] = ("already_exited", None)
            else:
                open_["stop"].append((i, us))
        else:
            want["verdict", i] = ("not_started" if not started else "ok" if stopped else "still_running", None)
    want |= {("launch", j): ("launched", None) for j, _ in open_["launch"]} | {("stop", j): ("not_stopped", None) for j, _ in open_["stop"]}
    assert got == want


def test_a_small_key_gives_one_frame():
    """Verdicts, launches, stops and the status of a key together, since each frame costs an Arrow batch; large ones come in leaves."""
    import pandas as pd
    import pyarrow as pa
    from fleetlens.streaming import monitor
    types = pa.schema([("lm_id", pa.int64()), ("lm_us", pa.int64()), ("action", pa.string()), ("launch_exit", pa.bool_()), ("stop_exit", pa.bool_()),
                       ("rc", pa.int32()), ("stop_ok", pa.bool_())])
    big = 2 ** 53 + 1
    acts = ["start", "stop", None, "collect", "start"]
    rows_in = pd.DataFrame({"lm_id": [big + i for i in range(5)], "lm_us": [10, 20, 30, 40, 50], "action": acts, "launch_exit": [a is None for a in acts],
                            "stop_exit": [a is None for a in acts], "rc": [None, None, 7, None, None], "stop_ok": True})
    for leaf in (4096, 4):
        m = monitor.Monitor(["k", "unit"], "event_id", types, 100, 5, 5, None, False, True, leaf=leaf)
        m.init(_Handle())
        got = list(m._run((1, "u1"), [rows_in], 1_000))
        assert sum(map(len, got)) == 8 and (len(got) == 1 if leaf > 8 else max(map(len, got)) <= 4)
        assert sorted((r.kind, r.event_id - big, r.outcome, None if r.returncode is pd.NA else r.returncode) for f in got for r in f.itertuples()) == [
            ("launch", 0, "launch_failed", 7), ("launch", 4, "launched", None), ("status", 4, "running", None), ("stop", 1, "killed", None),
            ("verdict", 0, "ok", None), ("verdict", 1, "ok", None), ("verdict", 3, "ok", None), ("verdict", 4, "already_started", None)]


def test_stops_of_idle_tasks_in_batch_and_stream(spark, tmp):
    from fleetlens.streaming.monitor import lifecycle_monitor
    from fleetlens.streaming.runner import drain_to_parquet, file_stream
    log = [(1, 0, "start", 0.0), (1, 5, "exit", 0.0), (1, 9, "stop", 0.0), (1, 11, "exit", 0.0), (2, 0, "stop", 0.0), (2, 4, "exit", 0.0), (2, 4.5, "stop", 0.0),
           (2, 5, "start", 0.0), (2, 6, "stop", 0.0), (3, 1, "start", 0.0), (3, 2, "stop", 0.0), (3, 500, "exit", 0.0), (4, 9_000, "collect", 0.0)]
    ev = _log(spark, log)
    folder = os.path.join(tmp, "idle")
    ev.write.parquet(folder)
    exit_ = F.col("kind") == "exit"
    m = lifecycle_monitor(file_stream(spark, folder, ev.schema), actions(), exit_, exit_, F.col("value"), grace_s=15, term_s=10, kill_s=10,
                          lateness="0 seconds", already_exited=True, leaf=2)
    got = drain_to_parquet(spark, m, "t5-idle").filter("kind = 'stop'")
    for hot in (2, 1000):
        want = stop_escalation(ev, ["user_id"], ORDER, F.col("kind") == "stop", exit_, term_s=10, kill_s=10, is_start=F.col("kind") == "start", hot_rows=hot)
        assert rows(got, "event_id", "outcome") == rows(want, "event_id", "outcome")
    assert rows(want, "user_id", "outcome") == [(1, "already_exited"), (2, "already_exited"), (2, "not_stopped"), (2, "terminated"), (3, "not_stopped")]


FOREIGN = """
import sys
sys.path.insert(0, sys.argv[1])  # this process finds the package; those that Spark starts do not
import duckdb
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[4] + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as E
store = "spark.sql.streaming.stateStore.providerClass"
before = spark.conf.get(store)
got = E.queries()[sys.argv[2]](spark, sys.argv[3])
assert spark.conf.get(store) == before and before.endswith("HDFSBackedStateStoreProvider")
con = duckdb.connect()
con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sys.argv[3]}/events.parquet')")
want = con.sql(E.oracle_sql()[sys.argv[2]])
cols = sorted(want.columns)
assert sorted(got.columns) == cols
order = lambda rs: sorted(rs, key=str)
a = order(tuple(r[c] for c in cols) for r in got.collect())
assert a == order(want.select(*cols).fetchall()) and a
print("SAME", len(a))
"""


@pytest.mark.parametrize("name, sf", [("lifecycle_monitor", "sf0.001"), ("lifecycle_stream", "sf0.001"), ("lifecycle_stream", "sf0.01"),
                                      ("lifecycle_monitor", "sf0.01")])
def test_streams_run_in_a_session_built_elsewhere(name, sf, tmp):
    """Spark's own defaults, and Python processes that cannot import the package."""
    import subprocess
    import sys
    from helpers import ROOT
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FOREIGN, ROOT, name, f"/root/testdata/{sf}", tmp], cwd=tmp, env=env, capture_output=True, text=True, timeout=600)
    assert "SAME" in done.stdout, (done.stdout + done.stderr)[-3000:]
