"""Expected artifacts of every task, and where each is collected to.

A capture task contributes its trace file; a transmit task contributes its
statistics file and its metrics file, when those options are present, in that
order.  The destination is ``<results>/<origin>/<basename>`` with origin
``local`` for the local runner and ``user@host`` for the remote one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.fixed import (CAPTURE_TYPE, DEFAULT_RESULTS_PATH, LOCAL_ORIGIN,
                             LOCAL_RUNNER, METRICS_OPTION, REMOTE_RUNNER, STATS_OPTION,
                             TRANSMIT_TYPE)
from fleetlens.functions.paths import basename, join_path, parent_dir


def locate(df: DataFrame, path, origin, results) -> DataFrame:
    """Add ``parent``, ``basename`` and ``destination`` for an artifact path."""
    p = F.col(path) if isinstance(path, str) else path
    return (df.withColumn("parent", parent_dir(p))
              .withColumn("basename", basename(p))
              .withColumn("destination", join_path(results, origin, basename(p))))


def origin_of(runner_type, username, host) -> Column:
    """Null for an unknown runner type or without user or host; the destination is then null too."""
    return F.when(F.col(runner_type) == LOCAL_RUNNER, F.lit(LOCAL_ORIGIN)) \
            .when(F.col(runner_type) == REMOTE_RUNNER, F.concat(F.col(username), F.lit("@"), F.col(host)))


def expected_artifacts(tasks: DataFrame) -> DataFrame:
    """Tasks table (``operators.explode.explode_tasks``) -> one row per
    expected artifact: run, task, pos, artifact_pos, role, path, origin,
    parent, basename, destination."""
    cfg = F.col("obj_config")
    opts = cfg["options_values"]
    entries = (F.when(F.col("obj_type") == CAPTURE_TYPE,
                      F.array(F.struct(F.lit("trace").alias("role"),
                                       cfg["tracefile_path"].alias("path"))))
                .when(F.col("obj_type") == TRANSMIT_TYPE,
                      F.array(F.struct(F.lit("stats").alias("role"),
                                       F.try_element_at(opts, F.lit(STATS_OPTION)).alias("path")),
                              F.struct(F.lit("metrics").alias("role"),
                                       F.try_element_at(opts, F.lit(METRICS_OPTION)).alias("path"))))
                .otherwise(F.array()))
    present = F.filter(entries, lambda e: e["path"].isNotNull())
    results = F.coalesce(F.col("collect_results_path"),
                         F.col("runner_config.collect_results_path"),
                         F.lit(DEFAULT_RESULTS_PATH))
    x = tasks.select("run", "task", "pos",
                     origin_of("runner_type", "runner_config.username",
                               "runner_config.host").alias("origin"),
                     results.alias("results"),
                     F.posexplode(present).alias("artifact_pos", "_a"))
    x = x.select("run", "task", "pos", "artifact_pos", F.col("_a.role").alias("role"),
                 F.col("_a.path").alias("path"), "origin", "results")
    return locate(x, "path", F.col("origin"), F.col("results")).drop("results")
