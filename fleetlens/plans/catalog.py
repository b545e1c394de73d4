"""Registered queries: every operator of the inventory, bound to the driver
tables (TPC-H-like tables plus ``events``, ``documents``, ``pages``, ...).

Each query reads whole tables and returns a DataFrame whose column names equal
those of the matching SQL in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions.artifacts import locate
from fleetlens.functions.commands import (capture_argv, capture_text, transmit_argv,
                                          transmit_text)
from fleetlens.functions.flatten import flatten_paths
from fleetlens.functions.params import render_params
from fleetlens.functions.paths import basename, parent_dir, url_host, url_path
from fleetlens.operators.asof import next_event
from fleetlens.operators.capture import capture_filter
from fleetlens.operators.dedupe import first_wins, last_wins
from fleetlens.operators.defaults import apply_defaults
from fleetlens.operators.explode import explode_params, explode_tasks
from fleetlens.operators.lifecycle import (current_status, launch_probe, lifecycle_check,
                                           stop_escalation)
from fleetlens.operators.ordering import order_tasks, timeline
from fleetlens.operators.periodic import periodic_stats
from fleetlens.operators.reconcile import reconcile, status_counts
from fleetlens.operators.rollup import failure_rollup, required_dirs, retry_outcome
from fleetlens.operators.routing import registry, route
from fleetlens.operators.sweep import sweep_grid
from fleetlens.sources.tables import table

# Full lineitem tie-break: with the order key as destination / run these
# columns order the lines of one order totally (whole rows are unique).
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
              "l_linestatus", "l_shipdate"]
LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
             "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
EVENT_ORDER = ["ts", "event_id"]
LIFECYCLE_ACTIONS = {"signup": "start", "error": "stop", "purchase": "collect"}


def _t(spark, d, name):
    return table(spark, d, name)


# ---- S / P: explode, parameters, defaults, routing, capture ---------------

def q_explode_tasks(spark, d):
    ev = _t(spark, d, "events").select(
        "event_id", "user_id", F.from_json("props", "map<string,string>").alias("tasks"))
    return explode_tasks(ev, "tasks", run_cols=["event_id", "user_id"])


def q_explode_params(spark, d):
    o = _t(spark, d, "orders")
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"),
                     F.lit("priority"), F.col("o_orderpriority"),
                     F.lit("custkey"), F.col("o_custkey").cast("string"))
    return explode_params(o, m, keep=["o_orderkey"])


def q_apply_defaults(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    lab = _t(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_m"))
    j = docs.join(lab, "doc_id", "left")
    out = apply_defaults(j, F.col("_m").isNotNull(), {"quality": -1, "toxic": 0},
                         overrides={"quality": F.when(F.col("toxic") == 1, F.lit(0))})
    return out.select("doc_id", "lang", "present", "quality", "toxic")


def q_route_specs(spark, d):
    reg = registry(spark, {"click": ("clicks", ["k"]), "view": ("views", ["k"]),
                           "purchase": ("purchases", ["k"]), "signup": ("signups", ["k"])})
    ev = _t(spark, d, "events").select(
        "event_id", "event_type", F.from_json("props", "map<string,string>").alias("m"))
    return route(ev, reg, "event_type", map_col="m").select(
        "event_id", "event_type", "handler", "accepted", "reason")


def q_capture_filter(spark, d):
    docs = _t(spark, d, "documents")
    return capture_filter(docs, F.col("lang") == "en", "text").select(
        "doc_id", "payload", "orig_len", "truncated")


# ---- J: reconcile, next event, sweep --------------------------------------

def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    # expected artifact per order (path = order key); found copies = lines
    expected = _t(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    found = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("path"), *[c for c in LINE_COLS if c != "l_orderkey"])
    r = reconcile(expected, found, on=["path"], destination="path", order=LINE_ORDER,
                  per_copy=True)
    return r.select(F.col("path").alias("o_orderkey"), "l_partkey", "l_suppkey",
                    "l_linenumber", "status")


def q_reconcile(spark, d):
    return _reconciled(spark, d)


def q_reconcile_counts(spark, d):
    return status_counts(_reconciled(spark, d))


def _events_of(spark, d, types):
    return _t(spark, d, "events").filter(F.col("event_type").isin(*types))


def q_next_event(spark, d):
    ev = _events_of(spark, d, ["error", "purchase"])
    x = next_event(ev, ["user_id"], EVENT_ORDER, F.col("event_type") == "error",
                   F.col("event_type") == "purchase", carry=["event_id"])
    return x.select("event_id", "user_id", "ts", "next_event_id", "next_ts", "delay_us")


def q_sweep_grid(spark, d):
    return sweep_grid(spark, {
        "region": _t(spark, d, "region").select("r_name"),
        "segment": _t(spark, d, "customer").select("c_mktsegment"),
        "etype": _t(spark, d, "events").select("event_type"),
    })


# ---- A: dedupe, roll-ups, periodic statistics ------------------------------

def _line_dups(spark, d, fn):
    li = _t(spark, d, "lineitem").select(*LINE_COLS)
    order = [c for c in LINE_ORDER if c != "l_linenumber"]
    return fn(li, ["l_orderkey", "l_linenumber"], order)


def q_first_wins(spark, d):
    return _line_dups(spark, d, first_wins)


def q_last_wins(spark, d):
    return _line_dups(spark, d, last_wins)


def q_failure_rollup(spark, d):
    o = _t(spark, d, "orders")
    return failure_rollup(o, ["o_custkey"], F.col("o_orderstatus") == "P",
                          F.col("o_orderstatus") == "O")


def q_retry_outcome(spark, d):
    tasks = _t(spark, d, "orders").select(F.col("o_orderkey"))
    att = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                          *[c for c in LINE_COLS if c != "l_orderkey"])
    return retry_outcome(tasks, att, ["o_orderkey"], LINE_ORDER, F.col("l_returnflag") == "N")


def q_required_dirs(spark, d):
    p = _t(spark, d, "pages").select(url_host("url").alias("host"), url_path("url").alias("path"))
    return required_dirs(p, "host", "path")


def q_periodic_stats(spark, d):
    ev = _t(spark, d, "events")
    return periodic_stats(ev, "ts", "1 hour", ["event_type"], "value", tiebreak="event_id")


# ---- W: ordering and timeline ---------------------------------------------

def _lines(spark, d):
    return _t(spark, d, "lineitem").select(*LINE_COLS)


def q_order_tasks(spark, d):
    x = order_tasks(_lines(spark, d), ["l_orderkey"], LINE_ORDER)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "start_rank", "stop_rank")


def q_timeline(spark, d):
    x = timeline(_lines(spark, d), ["l_orderkey"], LINE_ORDER,
                 start_cost=F.col("l_quantity").cast("bigint"),
                 stop_cost=F.col("l_linenumber").cast("bigint"), stop_after=70)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "start_at", "ready_at", "stop_at")


# ---- X: strings, arrays, maps ----------------------------------------------

def q_render_params(spark, d):
    li = _t(spark, d, "lineitem")
    return render_params(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"],
                         key="l_linenumber", value=F.col("l_partkey").cast("string"))


def _manifest_inputs(o: DataFrame) -> DataFrame:
    st = F.col("o_orderstatus")
    return o.select(
        "o_orderkey",
        F.when(st == "F", "snd").when(st == "O", "rcv").otherwise("fwd").alias("role"),
        F.when(st == "F", F.concat(F.lit("h"), (F.col("o_custkey") % 100).cast("string"))).alias("host"),
        (F.lit(4000) + F.col("o_custkey") % 1000).cast("string").alias("port"),
        F.when(st == "P", F.lit(None)).otherwise(
            F.create_map(F.lit("latency"), (F.col("o_orderkey") % 500).cast("string"),
                         F.lit("prio"), F.col("o_orderpriority"))).alias("attrs"),
        F.create_map(F.lit("--prio"), F.col("o_orderpriority"),
                     F.lit("--enable"), F.when(st == "F", "1").when(st == "O", F.lit(None))
                                         .otherwise(""),
                     F.lit("--key"), F.col("o_orderkey").cast("string")).alias("options"),
        F.col("o_orderpriority").alias("iface"),
        F.concat(F.lit("trace/"), F.col("o_orderkey").cast("string"), F.lit(".pcapng")).alias("tracefile"))


def q_command_manifest(spark, d):
    x = _manifest_inputs(_t(spark, d, "orders"))
    x = (x.withColumn("argv", transmit_argv(F.lit("bin/xmit"), "role", "host", "port",
                                            "attrs", "options"))
          .withColumn("cargv", capture_argv(F.lit("cap"), "iface", "port", "tracefile")))
    return x.select("o_orderkey", F.size("argv").cast("bigint").alias("argc"),
                    transmit_text("argv").alias("command"),
                    capture_text("cargv").alias("capture_command"))


def _page_parts(spark, d):
    return _t(spark, d, "pages").select(
        "page_id", url_host("url").alias("origin"), url_path("url").alias("path"))


def q_expected_artifacts(spark, d):
    p = _page_parts(spark, d)
    return locate(p, "path", F.col("origin"), F.lit("results")).select(
        "page_id", "path", "parent", "basename", "origin", "destination")


def _page_files(spark, d):
    return _page_parts(spark, d).select("page_id", F.concat(F.col("origin"), parent_dir("path")).alias("dir"),
                                        basename("path").alias("file"))


def q_flatten_paths(spark, d):
    # page_id completes the order: two pages may share a path
    x = flatten_paths(_page_files(spark, d), "dir", "file", ["/en", "/fr"], tiebreak=["page_id"])
    return x.select("page_id", "src", "dst", "subfolder", "kept")


def q_flatten_effects(spark, d):
    """X4, what the moves leave: folders without files, and files replaced.  Every fourth page has a twin outside its folder."""
    from fleetlens.functions.flatten import emptied_dirs, replaced_files
    files = _page_files(spark, d)
    twins = files.filter("page_id % 4 = 0").select("page_id", F.regexp_replace("dir", "/(en|fr)$", "").alias("dir"), "file")
    files = files.unionByName(twins)
    moves = flatten_paths(files, "dir", "file", ["/en", "/fr"], tiebreak=["page_id"])
    return emptied_dirs(files, moves, "dir").select(F.lit("emptied").alias("what"), F.col("dir").alias("path")).unionByName(
        replaced_files(files, moves, "dir", "file").select(F.lit("replaced").alias("what"), "path"))


# ---- T: lifecycle ----------------------------------------------------------

def _rc(c="value"):
    return F.floor(F.col(c)).cast("int")


def q_current_status(spark, d):
    ev = _events_of(spark, d, ["signup", "error"])
    tasks = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return current_status(ev, ["user_id"], EVENT_ORDER, F.col("event_type") == "signup",
                          F.col("event_type") == "error", _rc(), tasks=tasks)


def _action():
    a = None
    for t, act in LIFECYCLE_ACTIONS.items():
        a = F.when(F.col("event_type") == t, act) if a is None else a.when(F.col("event_type") == t, act)
    return a


def q_lifecycle_check(spark, d):
    ev = _events_of(spark, d, list(LIFECYCLE_ACTIONS))
    x = lifecycle_check(ev, ["user_id"], EVENT_ORDER, _action())
    return x.select("event_id", "user_id", "action", "verdict")


def q_launch_probe(spark, d):
    ev = _events_of(spark, d, ["signup", "error"]).withColumn("rc", _rc())
    x = launch_probe(ev, ["user_id"], EVENT_ORDER, F.col("event_type") == "signup",
                     F.col("event_type") == "error", "rc", grace_s=24 * 3600)
    return x.select("event_id", "user_id", "ts", "launched", "returncode")


def q_stop_escalation(spark, d):
    ev = _events_of(spark, d, ["error", "purchase"])
    x = stop_escalation(ev, ["user_id"], EVENT_ORDER, F.col("event_type") == "error",
                        F.col("event_type") == "purchase", term_s=12 * 3600, kill_s=12 * 3600)
    return x.select("event_id", "user_id", "ts", "outcome")


def q_stop_outcomes(spark, d):
    """T4 with all four outcomes: whether a task was idle at the request comes from the same events."""
    ev = _events_of(spark, d, ["signup", "error", "purchase"])
    x = stop_escalation(ev, ["user_id"], EVENT_ORDER, F.col("event_type") == "error", F.col("event_type") == "purchase",
                        term_s=12 * 3600, kill_s=12 * 3600, is_start=F.col("event_type") == "signup")
    return x.select("event_id", "user_id", "ts", "outcome")


QUERIES = {
    "explode_tasks": q_explode_tasks,
    "explode_params": q_explode_params,
    "apply_defaults": q_apply_defaults,
    "route_specs": q_route_specs,
    "capture_filter": q_capture_filter,
    "reconcile": q_reconcile,
    "reconcile_counts": q_reconcile_counts,
    "next_event": q_next_event,
    "sweep_grid": q_sweep_grid,
    "first_wins": q_first_wins,
    "last_wins": q_last_wins,
    "failure_rollup": q_failure_rollup,
    "retry_outcome": q_retry_outcome,
    "required_dirs": q_required_dirs,
    "periodic_stats": q_periodic_stats,
    "order_tasks": q_order_tasks,
    "timeline": q_timeline,
    "render_params": q_render_params,
    "command_manifest": q_command_manifest,
    "expected_artifacts": q_expected_artifacts,
    "flatten_paths": q_flatten_paths,
    "flatten_effects": q_flatten_effects,
    "current_status": q_current_status,
    "lifecycle_check": q_lifecycle_check,
    "launch_probe": q_launch_probe,
    "stop_escalation": q_stop_escalation,
    "stop_outcomes": q_stop_outcomes,
}


# ---- S3 and streams: data written / streamed from the driver tables --------

TS_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def q_read_stats(spark, d):
    """Round trip: events written as CSV files in the collected layout
    (run = event type, origin = user bucket), read back with lineage.  Clicks have other columns in
    another order than the rest; files are merged by name."""
    from fleetlens.session import shared_dir
    from fleetlens.sources.stats import read_stats
    root = shared_dir(spark, "stats")
    ev = _t(spark, d, "events").withColumn("run", F.concat(F.lit("run of "), "event_type")) \
        .withColumn("origin", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")))
    other = F.col("event_type") == "click"
    for part, cols in ((ev.filter(~other), ["event_id", "ts", "user_id", "value", "props"]),
                       (ev.filter(other).withColumn("extra", F.lit("x")), ["value", "user_id", "extra", "event_id", "ts"])):
        (part.select("run", "origin", *cols).write.mode("append").partitionBy("run", "origin").option("header", True)
             .option("timestampNTZFormat", TS_MICROS).csv(root))
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, value DOUBLE, props STRING"
    st = read_stats(spark, root, globs=("*.csv",), schema=schema, timestampNTZFormat=TS_MICROS)
    return st.select("run", "origin", "event_id", "ts", "user_id", "value", "props")


def _event_stream(spark, d, max_files_per_trigger=None):
    from fleetlens.streaming.runner import table_stream
    return table_stream(spark, d, "events", _t(spark, d, "events").schema, max_files_per_trigger)


def _task_stream(spark, d, max_files_per_trigger=None):
    """Lifecycle events, each task known by two columns: the user and a unit, a string."""
    return _event_stream(spark, d, max_files_per_trigger).filter(F.col("event_type").isin(*LIFECYCLE_ACTIONS)) \
        .withColumn("unit", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")))


def q_periodic_stats_stream(spark, d, max_files_per_trigger=None):
    from fleetlens.streaming.periodic import periodic_stats_stream
    from fleetlens.streaming.runner import drain_to_parquet
    s = periodic_stats_stream(_event_stream(spark, d, max_files_per_trigger), "ts", "1 hour", ["event_type"], "value",
                              lateness="1 hour", tiebreak="event_id")
    return drain_to_parquet(spark, s, "periodic-stream")


def q_lifecycle_stream(spark, d, max_files_per_trigger=None):
    from fleetlens.streaming.lifecycle import lifecycle_stream
    from fleetlens.streaming.runner import drain_to_parquet
    s = _task_stream(spark, d, max_files_per_trigger)
    return drain_to_parquet(spark, lifecycle_stream(s, _action(), key=["user_id", "unit"]), "lifecycle-stream")


QUERIES.update({
    "read_stats": q_read_stats,
    "periodic_stats_stream": q_periodic_stats_stream,
    "lifecycle_stream": q_lifecycle_stream,
})


def q_lifecycle_monitor(spark, d, max_files_per_trigger=None):
    """T5 in full: verdicts plus launch (signup -> next error, 24 h grace) and
    stop (error -> next purchase, 12 h + 12 h) outcomes, one stream."""
    from fleetlens.streaming.monitor import lifecycle_monitor
    from fleetlens.streaming.runner import drain_to_parquet
    m = lifecycle_monitor(_task_stream(spark, d, max_files_per_trigger), _action(), launch_exit=F.col("event_type") == "error",
                          stop_exit=F.col("event_type") == "purchase", returncode=_rc(), key=["user_id", "unit"],
                          grace_s=24 * 3600, term_s=12 * 3600, kill_s=12 * 3600)
    return drain_to_parquet(spark, m.drop("action"), "lifecycle-monitor")


QUERIES["lifecycle_monitor"] = q_lifecycle_monitor


# ---- S1 and the spec flow, on specs Spark derives from the events table ----

def _specs_from_events(spark, d):
    """One spec per event, written as JSON Lines to the shared folder: a
    capture task and a transmit task whose settings come from the event.
    Null fields are left out of the JSON, i.e. those keys are absent."""
    from fleetlens.fixed import CAPTURE_TYPE, LOCAL_RUNNER, REMOTE_RUNNER, TRANSMIT_TYPE
    from fleetlens.session import shared_dir
    ev = _t(spark, d, "events")
    eid = F.col("event_id").cast("string")
    port = F.from_json("props", "map<string,string>")["k"]
    host = F.concat(F.lit("192.0.2."), (F.col("user_id") % 250).cast("string"))
    remote = F.col("user_id") % 2 == 0
    role = F.when(F.col("event_type") == "click", "snd").when(F.col("event_type") == "view", "rcv") \
            .otherwise("fwd")
    s_null, i_null = F.lit(None).cast("string"), F.lit(None).cast("int")
    m_null = F.lit(None).cast("map<string,string>")

    def task(obj_type, path, port_, interface, tracefile, typ, host_, attrs, options,
             runner_type, username, runner_host):
        cfg = F.struct(path.alias("path"), port_.alias("port"), interface.alias("interface"),
                       tracefile.alias("tracefile_path"), typ.alias("type"), host_.alias("host"),
                       attrs.alias("attrs_values"), options.alias("options_values"))
        return F.struct(F.lit(obj_type).alias("obj_type"), cfg.alias("obj_config"),
                        runner_type.alias("runner_type"),
                        F.struct(username.alias("username"), runner_host.alias("host"))
                         .alias("runner_config"),
                        i_null.alias("sleep_after_start"), i_null.alias("sleep_after_stop"),
                        i_null.alias("stop_order"))

    capture = task(CAPTURE_TYPE, F.lit("capbin"), port,
                   F.concat(F.lit("if"), (F.col("user_id") % 4).cast("string")),
                   F.concat(F.lit("/data/e"), eid, F.lit("/trace.pcapng")), s_null, s_null,
                   m_null, m_null, F.lit(LOCAL_RUNNER), s_null, s_null)
    transmit = task(TRANSMIT_TYPE, F.lit("bin/xmit"), port, s_null, s_null, role,
                    F.when(role == "snd", host),
                    F.create_map(F.lit("latency"), F.floor(F.col("value") * 10).cast("string")),
                    F.create_map(F.lit("--statsfile"), F.concat(F.lit("/data/e"), eid, F.lit("/stats.csv")),
                                 F.lit("--enable-metrics"), s_null),
                    F.when(remote, REMOTE_RUNNER).otherwise(LOCAL_RUNNER),
                    F.when(remote, F.lit("u")), F.when(remote, host))
    spec = F.struct(F.concat(F.lit("results/e"), eid).alias("collect_results_path"),
                    F.floor("value").cast("int").alias("stop_after"),
                    F.lit(True).alias("ignore_stop_order"),
                    F.create_map(F.lit("1"), capture, F.lit("2"), transmit).alias("tasks"))
    out = shared_dir(spark, "specs")
    ev.select(F.to_json(spec).alias("value")).write.text(out)
    return f"{out}/*.txt"


def _spec_tasks(spark, d):
    from fleetlens.operators.specs import spec_tasks
    from fleetlens.sources.specs import read_specs
    return spec_tasks(read_specs(spark, _specs_from_events(spark, d), json_lines=True))


def q_read_specs(spark, d):
    from fleetlens.sources.specs import read_specs
    s = read_specs(spark, _specs_from_events(spark, d), json_lines=True)
    return s.select("run", "stop_after", "ignore_stop_order",
                    F.size("tasks").cast("bigint").alias("n_tasks"), "malformed")


def q_spec_manifest(spark, d):
    from fleetlens.operators.specs import command_manifest, validate_tasks
    accepted, _ = validate_tasks(spark, _spec_tasks(spark, d))
    return command_manifest(accepted, keep=["warning"]).select(
        "run", "task", "pos", "obj_type", "runner_type", "command", "warning")


def q_spec_artifacts(spark, d):
    from fleetlens.functions.artifacts import expected_artifacts
    a = expected_artifacts(_spec_tasks(spark, d))
    return a.select("run", "task", "artifact_pos", "role", "path", "origin", "destination")


QUERIES.update({
    "read_specs": q_read_specs,
    "spec_manifest": q_spec_manifest,
    "spec_artifacts": q_spec_artifacts,
})


def q_decode_run(spark, d):
    """J3 inverse: parameters decoded from the generated run names."""
    from fleetlens.operators.sweep import decode_run
    g = q_sweep_grid(spark, d)
    return g.select("run", *decode_run(F.col("run"), ["region", "segment", "etype"]))


def q_write_new(spark, d):
    """The events table written through the fail-if-exists sink into a
    fresh shared folder (a second write must be refused), read back."""
    from fleetlens.session import shared_dir
    from fleetlens.sources.sinks import write_new
    out = shared_dir(spark, "write-new")
    ev = _t(spark, d, "events")
    write_new(ev, out)
    try:
        write_new(ev.limit(0), out)
    except AnalysisException as e:  # refused: the folder exists
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    else:
        raise RuntimeError(f"write_new overwrote {out}")
    return spark.read.parquet(out)


QUERIES.update({"decode_run": q_decode_run, "write_new": q_write_new})


# ---- the artifact chain, rejects and the catalog ----------------------------

def q_reconcile_full(spark, d):
    """J1 at the artifact grain with every status: destinations differ from paths, the order leads with
    a string, found paths repeat, tasks fail their prechecks and transfers fail."""
    li = _t(spark, d, "lineitem")
    expected = li.select(
        F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("task"), *[c for c in LINE_ORDER if c != "l_returnflag"],
        F.concat(F.lit("/src/p"), F.col("l_partkey").cast("string")).alias("path"),
        F.concat(F.lit("out/"), (F.col("l_orderkey") * 7 + F.col("l_suppkey") % 3).cast("string")).alias("destination"),
        F.when(F.col("l_quantity") < 3, "not_started").when(F.col("l_quantity") < 5, "not_stopped")
         .when(F.col("l_quantity") < 7, "no_destination").alias("precheck"),
        (F.col("l_tax") < 0.07).alias("transfer_ok"))
    found = _t(spark, d, "part").filter("p_partkey % 5 > 0").select(
        F.concat(F.lit("/src/p"), F.col("p_partkey").cast("string")).alias("path"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("copy"))
    order = ["run", "task", *[c for c in LINE_ORDER if c != "l_returnflag"]]
    out = reconcile(expected, found, on=["path"], destination="destination", order=order, precheck="precheck",
                    transfer_ok="transfer_ok", scope=["run"])
    return out.select("run", "task", "l_linenumber", "l_partkey", "l_suppkey", "destination", "status")


def _broken_specs(spark, d):
    """The event-derived specs, some of them broken: cut off, without tasks, of an unknown object type, or without a role."""
    from fleetlens.session import shared_dir
    text = spark.read.text(_specs_from_events(spark, d))
    n = F.regexp_extract("value", r'"collect_results_path":"results/e([0-9]+)"', 1).cast("bigint")
    bad = F.when(n % 11 == 1, F.expr("substring(value, 1, length(value) - 5)")) \
           .when(n % 11 == 2, F.regexp_replace("value", r',"tasks":.*$', "}")) \
           .when(n % 11 == 3, F.regexp_replace("value", r'"2":\{"obj_type":"[^"]*"', '"2":{"obj_type":"unknown"')) \
           .when(n % 11 == 4, F.regexp_replace("value", r'"type":"[^"]*"', '"type":null')).otherwise(F.col("value"))
    out = shared_dir(spark, "broken-specs")
    text.select(bad.alias("value")).write.text(out)
    return f"{out}/*.txt"


def _broken(spark, d):
    from fleetlens.sources.specs import read_specs
    return read_specs(spark, _broken_specs(spark, d), json_lines=True)


def q_spec_rejects(spark, d):
    """S1 and P4 on partly broken specs: specs and tasks rejected, with reasons, and tasks accepted, with warnings."""
    from fleetlens.operators.specs import spec_rejects, spec_tasks, validate_tasks
    specs = _broken(spark, d)
    accepted, rejected = validate_tasks(spark, spec_tasks(specs))
    none = F.lit(None).cast("string")
    return spec_rejects(specs).select("run", none.alias("task"), "reason", none.alias("warning")) \
        .unionByName(rejected.select("run", "task", "reason", "warning")) \
        .unionByName(accepted.select("run", "task", none.alias("reason"), "warning"))


def q_collected_status(spark, d):
    """S1 -> P1 -> P4 -> X3 -> S2 -> J1: status of every artifact that the accepted tasks promise, against a listing."""
    from fleetlens.functions.artifacts import expected_artifacts
    from fleetlens.operators.specs import spec_tasks, validate_tasks
    from fleetlens.sources.catalog import from_listing
    accepted, _ = validate_tasks(spark, spec_tasks(_broken(spark, d)))
    ev = _t(spark, d, "events")
    listing = ev.select(F.explode(F.array(
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("file:/data/e"), F.col("event_id").cast("string"), F.lit("/stats.csv"))),
        F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("/data/e"), F.col("event_id").cast("string"), F.lit("/trace.pcapng"))))).alias("path")) \
        .filter("path is not null")
    found = from_listing(listing).select(F.col("local_path").alias("path"))
    out = reconcile(expected_artifacts(accepted), found, on=["path"], destination="destination",
                    order=["run", "pos", "artifact_pos"], scope=["run"])
    return out.select("run", "task", "role", "path", "destination", "status")


def q_collected_checked(spark, d):
    """S1 -> T2 -> J1: as ``collected_status``, with the prechecks of each task taken from its event log as it was when
    it was collected.  Some tasks never started, some never stopped, some had no collect, and all were started and stopped after it."""
    from fleetlens.functions.artifacts import expected_artifacts
    from fleetlens.operators.specs import collect_prechecks, spec_tasks, validate_tasks, with_prechecks
    accepted, _ = validate_tasks(spark, spec_tasks(_broken(spark, d)))
    ev, eid = _t(spark, d, "events"), F.col("event_id")
    steps = [("start", 0, eid % 5 > 0), ("stop", 60, eid % 7 > 0), ("collect", 120, eid % 13 > 0), ("start", 180, F.lit(True)), ("stop", 240, F.lit(True))]
    log = ev.select(F.concat(F.lit("results/e"), eid.cast("string")).alias("run"), "ts", F.explode(F.array(*[F.lit(t) for t in "12"])).alias("task"),
                    F.array(*[F.when(ok, F.struct(F.lit(a).alias("what"), F.lit(s).alias("after"))) for a, s, ok in steps]).alias("steps")) \
        .select("run", "task", "ts", F.explode(F.filter("steps", lambda x: x.isNotNull())).alias("step")).select("run", "task", "ts", "step.*")
    log = log.withColumn("at", F.expr("ts + make_dt_interval(0, 0, 0, after)"))
    checks = collect_prechecks(log, ["run", "task"], ["at", "after"], F.col("what"))
    expected = with_prechecks(expected_artifacts(accepted), checks, ["run", "task"])
    found = ev.select(F.explode(F.array(F.concat(F.lit("/data/e"), eid.cast("string"), F.lit("/stats.csv")),
                                        F.when(eid % 4 > 0, F.concat(F.lit("/data/e"), eid.cast("string"), F.lit("/trace.pcapng"))))).alias("path")).filter("path is not null")
    out = reconcile(expected, found, on=["path"], destination="destination", order=["run", "pos", "artifact_pos"], precheck="precheck", scope=["run"])
    return out.select("run", "task", "role", "path", "destination", "status")


def q_file_catalog(spark, d):
    """A tree written by Spark (run and origin folders), listed without reading content; its folders."""
    from fleetlens.session import shared_dir
    from fleetlens.sources.catalog import file_catalog
    root = shared_dir(spark, "tree")
    _t(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("unit"), "props") \
        .write.partitionBy("event_type", "unit").text(root)
    cat = file_catalog(spark, root, glob="*.txt")
    return cat.select(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("dir"), (F.col("length") > 0).alias("filled")).distinct()


def q_list_tree(spark, d):
    """S2 without the driver's listing: the same kind of tree, listed level by level in tasks; bytes of its folders."""
    from fleetlens.session import shared_dir
    from fleetlens.sources.catalog import list_tree
    root = shared_dir(spark, "tree")
    _t(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("unit"), "props") \
        .write.partitionBy("event_type", "unit").text(root)
    cat = list_tree(spark, root, glob="part-*.txt")
    return cat.groupBy(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("dir")).agg(F.sum("length").alias("bytes"))


def q_stop_order(spark, d):
    """W1 with stop orders honoured: tasks that have one stop first."""
    x = _lines(spark, d).withColumn("stop_order", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")))
    x = order_tasks(x, ["l_orderkey"], LINE_ORDER, honor_stop_order=True)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start_rank", "stop_rank")


def q_spec_timeline(spark, d):
    from fleetlens.operators.specs import spec_timeline
    x = spec_timeline(_spec_tasks(spark, d), honor_stop_order=True)
    return x.select("run", "task", "start_rank", "stop_rank", "start_at", "ready_at", "stop_at")


QUERIES.update({"reconcile_full": q_reconcile_full, "spec_rejects": q_spec_rejects, "collected_status": q_collected_status, "collected_checked": q_collected_checked,
                "file_catalog": q_file_catalog, "list_tree": q_list_tree, "stop_order": q_stop_order, "spec_timeline": q_spec_timeline})
