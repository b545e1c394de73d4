"""A3-A5: failure roll-up, retry outcome, required directories.

All three are aggregations (partial aggregation before the shuffle), so a hot
run or task is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.fixed import MAX_STOP_ATTEMPTS
from fleetlens.functions.paths import parent_dir
from fleetlens.plans.skew import top_n


def failure_rollup(outcomes: DataFrame, run, not_stopped: Column,
                   collect_failed: Column) -> DataFrame:
    """Per run: task count, tasks not stopped, collects failed, and ``ok``.

    Go-on-after-failure: every task is counted; the run fails when any task
    was not stopped.  Collect failures are counted but, as in the spec runner,
    do not fail the run."""
    run = list(run)
    return (outcomes.groupBy(*run)
                    .agg(F.count(F.lit(1)).alias("n_tasks"),
                         F.count_if(F.coalesce(not_stopped, F.lit(False))).alias("n_not_stopped"),
                         F.count_if(F.coalesce(collect_failed, F.lit(False))).alias("n_collect_failed"))
                    .withColumn("ok", F.col("n_not_stopped") == 0))


def retry_outcome(tasks: DataFrame, attempts: DataFrame, key, order, ok: Column,
                  max_attempts: int = MAX_STOP_ATTEMPTS) -> DataFrame:
    """At most ``max_attempts`` attempts per task, only for tasks that had
    any: ``ok_first``, ``ok_retry`` (a later attempt succeeded), ``failed``;
    a task with no attempt is ``skipped``.

    The first attempts per task are a top-n (partial WindowGroupLimit before
    the shuffle), so at most ``max_attempts`` rows per task cross the network.
    """
    key, order = list(key), list(order)
    first = top_n(attempts.withColumn("_ro_ok", F.coalesce(ok, F.lit(False))),
                  key, order, max_attempts, rank="_ro_rank")
    summ = (first.groupBy(*key)
                 .agg(F.count(F.lit(1)).alias("n_attempts"),
                      F.min(F.when(F.col("_ro_ok"), F.col("_ro_rank"))).alias("_ro_first_ok")))
    out = tasks.select(*key).join(summ, key, "left")
    return out.select(
        *key,
        F.coalesce(F.col("n_attempts"), F.lit(0)).cast("bigint").alias("n_attempts"),
        F.when(F.col("n_attempts").isNull(), "skipped")
         .when(F.col("_ro_first_ok") == 1, "ok_first")
         .when(F.col("_ro_first_ok").isNotNull(), "ok_retry")
         .otherwise("failed").alias("outcome"))


def required_dirs(artifacts: DataFrame, origin: str, path: str) -> DataFrame:
    """Distinct ``(origin, dir)``: the directories to create, each once."""
    return (artifacts.select(F.col(origin).alias("origin"), parent_dir(path).alias("dir"))
                     .distinct())
