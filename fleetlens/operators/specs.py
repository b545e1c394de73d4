"""The spec flow: spec files -> tasks -> validation -> commands -> artifacts.

Composes S1, P1, P3, P4, X2 and X3 for real spec files; each step is a
narrow DataFrame transformation except the broadcast registry joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.fixed import (CAPTURE_TYPE, LOCAL_RUNNER, NULL_TEXT, REMOTE_RUNNER,
                             ROLE_RECEIVER, ROLE_SENDER, TRANSMIT_TYPE)
from fleetlens.functions.commands import (capture_argv, capture_text, transmit_argv,
                                          transmit_text)
from fleetlens.operators.explode import explode_tasks
from fleetlens.operators.routing import registry, route

RUN_COLS = ["run", "collect_results_path", "stop_after", "ignore_stop_order"]


def _empty_map():
    return F.create_map().cast("map<string,string>")

# required keys per type (what the spec runner indexes without a default)
OBJECT_TYPES = {
    CAPTURE_TYPE: ("capture", ["path", "interface", "port", "tracefile_path"]),
    TRANSMIT_TYPE: ("transmit", ["type", "path", "port"]),
}
RUNNER_TYPES = {
    LOCAL_RUNNER: ("local", []),
    REMOTE_RUNNER: ("remote", ["username", "host"]),
}


def spec_tasks(specs: DataFrame) -> DataFrame:
    """One row per task (start order ``pos``), with ``host_value``: the host
    as the spec runner renders it (absent -> ``''``, present null ->
    ``None``)."""
    # a malformed spec has no task map, so it explodes to no rows; a filter on
    # it would be pushed below the parse and parse every spec twice
    t = explode_tasks(specs, "tasks", run_cols=RUN_COLS)
    has_host = F.coalesce(F.array_contains("obj_config_keys", "host"), F.lit(False))
    return t.withColumn("host_value", F.when(has_host, F.coalesce(F.col("obj_config.host"),
                                                                   F.lit(NULL_TEXT)))
                                        .otherwise(F.lit("")))


def spec_rejects(specs: DataFrame) -> DataFrame:
    """``run, reason`` of the specs that give no tasks (empty, invalid_json, no_tasks), so that none is
    dropped without a word; the other specs' tasks go to ``validate_tasks``."""
    return specs.filter("malformed").select("run", F.col("error").alias("reason"))


def _keys_map(c):
    k = F.coalesce(F.col(c), F.array().cast("array<string>"))
    return F.map_from_arrays(k, k)


def validate_tasks(spark: SparkSession, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): unknown object / runner type, missing required
    keys.  A transmit role without a subcommand is accepted with a
    ``warning``."""
    t = (tasks.withColumn("_ok", _keys_map("obj_config_keys"))
              .withColumn("_rk", _keys_map("runner_config_keys")))
    r1 = route(t, registry(spark, OBJECT_TYPES), "obj_type", map_col="_ok",
               reason="_r_obj", handler="obj_handler").drop("accepted")
    r2 = route(r1, registry(spark, RUNNER_TYPES), "runner_type", map_col="_rk",
               reason="_r_run", handler="runner_handler").drop("accepted")
    role = F.col("obj_config.type")
    out = (r2.withColumn("reason", F.concat_ws(";", "_r_obj", "_r_run"))
             .withColumn("reason", F.when(F.col("reason") != "", F.col("reason")))
             .withColumn("warning", F.when((F.col("obj_type") == TRANSMIT_TYPE)
                                           & ~F.coalesce(role.isin(ROLE_SENDER, ROLE_RECEIVER), F.lit(False)),
                                           F.concat(F.lit("no_subcommand:"),
                                                    F.coalesce(role, F.lit("null")))))
             .drop("_ok", "_rk", "_r_obj", "_r_run"))
    return out.filter(F.col("reason").isNull()).drop("reason"), out.filter(F.col("reason").isNotNull())


def command_manifest(tasks: DataFrame, keep=()) -> DataFrame:
    """X2 for spec tasks: ``argv`` (array<string>) and ``command`` (text);
    ``keep`` names further task columns to carry along."""
    cfg = F.col("obj_config")
    cap = F.col("obj_type") == CAPTURE_TYPE
    argv = (F.when(cap, capture_argv(cfg["path"], cfg["interface"], cfg["port"],
                                     cfg["tracefile_path"]))
             .when(F.col("obj_type") == TRANSMIT_TYPE,
                   transmit_argv(cfg["path"], cfg["type"], F.col("host_value"), cfg["port"],
                                 cfg["attrs_values"],
                                 F.coalesce(cfg["options_values"], _empty_map()))))
    x = tasks.withColumn("argv", argv)
    text = F.when(cap, capture_text("argv")).otherwise(transmit_text("argv"))
    return x.select("run", "task", "pos", "obj_type", "runner_type", *keep, "argv",
                    text.alias("command"))


def prechecks(flags: DataFrame, keys, started: str = "started", stopped: str = "stopped",
              has_destination: str | None = None) -> DataFrame:
    """Per task: the collect precheck failure (null when it passes), in the
    spec runner's order: not started, not stopped, no destination."""
    c = F.when(~F.coalesce(F.col(started), F.lit(False)), "not_started") \
         .when(~F.coalesce(F.col(stopped), F.lit(False)), "not_stopped")
    if has_destination:
        c = c.when(~F.coalesce(F.col(has_destination), F.lit(False)), "no_destination")
    return flags.select(*keys, c.alias("precheck"))


def collect_prechecks(events: DataFrame, keys, order, action, stop_ok=None, hot_rows: int | None = None) -> DataFrame:
    """Per task the precheck of its last collect, from the event log: the flags started and stopped as they were at that
    event (T2), whatever came later.  Tasks that were never collected have no row."""
    from fleetlens.operators.lifecycle import lifecycle_check
    from fleetlens.plans.scan import HOT_ROWS
    judged = lifecycle_check(events, keys, order, action, stop_ok, hot_rows=hot_rows or HOT_ROWS)
    last = F.max_by(F.struct("started", "stopped"), F.struct(*order))
    flags = judged.filter(F.col("action") == "collect").groupBy(*keys).agg(last.alias("_f")).select(*keys, "_f.*")
    return prechecks(flags, keys)


def with_prechecks(expected: DataFrame, checks: DataFrame, keys) -> DataFrame:
    """``expected`` with ``precheck``; ``not_started`` where the task has no collect event."""
    checks = checks.select(*keys, F.struct("precheck").alias("_c"))
    return expected.join(checks, list(keys), "left").withColumn(
        "precheck", F.when(F.col("_c").isNull(), "not_started").otherwise(F.col("_c.precheck"))).drop("_c")


def probe_wait_s(runner_type: str = "runner_type"):
    """Launch probe wait of a task's runner, in seconds (bigint): the grace
    for ``operators.lifecycle.launch_probe`` and the fixed start cost of a
    task in ``spec_timeline``."""
    from fleetlens.fixed import PROBE_WAIT_LOCAL_S, PROBE_WAIT_REMOTE_S
    return F.when(F.col(runner_type) == REMOTE_RUNNER, F.lit(PROBE_WAIT_REMOTE_S)) \
            .otherwise(F.lit(PROBE_WAIT_LOCAL_S)).cast("bigint")


def spec_timeline(tasks: DataFrame, honor_stop_order: bool = False) -> DataFrame:
    """W1 + W2 for spec tasks: start / stop ranks and nominal offsets in
    seconds.  Each start costs the launch probe wait of its runner (local or
    remote) plus ``sleep_after_start``; a task is ready once its probe wait
    is over; the run lasts ``stop_after``; stops follow in stop order, each
    followed by ``sleep_after_stop``."""
    from fleetlens.operators.ordering import timeline

    probe = probe_wait_s()
    return timeline(tasks, ["run"], ["pos"],
                    start_cost=probe + F.coalesce(F.col("sleep_after_start"), F.lit(0)).cast("bigint"),
                    stop_cost=F.coalesce(F.col("sleep_after_stop"), F.lit(0)).cast("bigint"),
                    stop_after=F.col("stop_after").cast("bigint"), ready_offset=probe,
                    honor_stop_order=honor_stop_order, ranks=True)
