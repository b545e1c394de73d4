"""Artifact reconciliation (the flagship operator).

For every expected artifact one status, in this precedence:

1. a task-level precheck failure carried by the expected row
   (``not_started``, ``not_stopped``, ``no_destination``);
2. ``missing``: no file was found at the expected path (warn and go on);
3. ``conflict``: the destination was already taken by an earlier artifact in
   task order (exclusive create: nothing is overwritten);
4. ``error``: the transfer failed; it leaves the destination free for the next one;
5. ``collected``.

Only found artifacts whose transfer worked take a destination.

Plan shape (no per-destination window, so a hot destination or a hot path is
never one task):

* ``found`` is reduced to its distinct paths (partial aggregation) and left-joined
  once to ``expected``, so copies of a file do not multiply an artifact; a hot path sits on
  the streamed side, which AQE's skew-join rule splits;
* whether a destination is taken is an "any before" over its rows, by a segmented scan
  (``plans.scan``): one window per destination, and a hot
  destination is cut into buckets of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.plans.scan import B, HOT, HOT_ROWS, bucketize, prefix_scan

STATUSES = ("not_started", "not_stopped", "no_destination", "missing",
            "conflict", "error", "collected")


def reconcile(expected: DataFrame, found: DataFrame, on, destination: str,
              order, precheck: str | None = None,
              transfer_ok: str | None = None, scope=(), per_copy: bool = False,
              status: str = "status", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Reconcile expected artifacts with the files found.

    :param expected: one row per expected artifact; holds the ``on`` columns
        and, when given, ``precheck`` (null = passed, else the failure status).
    :param found: rows of files found; holds the ``on`` columns (a path may
        appear several times, e.g. copies on several origins).
    :param on: join column names shared by both sides (the source path).
    :param destination: column naming the destination.
    :param order: columns giving the task order; first wins.
    :param transfer_ok: optional boolean column of either side; false means the copy failed.
    :param scope: columns (the run) within which destinations are compared; runs that write to
        the same folder must leave it empty.
    :param per_copy: one row per found copy, each competing for the destination, with the
        columns of ``found``; without it one row and one status per expected artifact.
    :returns: expected columns (with ``per_copy`` also those of ``found``) and ``status``.
    """
    on, order, scope = list(on), list(order), list(scope)
    if per_copy:
        there = found
    elif transfer_ok is not None and transfer_ok not in expected.columns:  # recorded per copy: one that worked will do
        there = found.groupBy(*on).agg(F.max(transfer_ok).alias(transfer_ok))
    else:
        there = found.select(*on).distinct()
    there = there.withColumn("_rc_found", F.lit(True))
    l, r = expected.alias("_rl"), there.alias("_rr")
    cond = None
    for c in on:
        one = F.col(f"_rl.{c}") == F.col(f"_rr.{c}")
        cond = one if cond is None else cond & one
    x = l.join(r, cond, "left").select(
        *[F.col(f"_rl.{c}") for c in expected.columns], *[F.col(f"_rr.{c}") for c in there.columns if c not in on])
    passed: Column = F.lit(True) if precheck is None else F.col(precheck).isNull()
    ok: Column = F.lit(True) if transfer_ok is None else F.coalesce(F.col(transfer_ok), F.lit(True))
    here = F.coalesce(F.col("_rc_found"), F.lit(False))
    x = x.withColumn("_rc_takes", passed & here & ok)
    keys = [*scope, destination]
    # boundaries come from the narrow side, ahead of the join
    base = expected if set(keys + order) <= set(expected.columns) else None
    x = prefix_scan(bucketize(x, keys, order, hot_rows, base=base), keys, order, [("_rc_taken", "or", F.col("_rc_takes"))])
    state = F.when(~here, "missing").when(F.coalesce(F.col("_rc_taken"), F.lit(False)), "conflict") \
             .when(~ok, "error").otherwise("collected")
    if precheck is not None:
        state = F.coalesce(F.col(precheck), state)
    return x.withColumn(status, state).drop("_rc_found", "_rc_takes", "_rc_taken", B, HOT)


def status_counts(reconciled: DataFrame, status: str = "status") -> DataFrame:
    """Artifacts per status: the one-line answer to "what was collected"."""
    return (reconciled.groupBy(status)
                      .agg(F.count(F.lit(1)).alias("n_artifacts")))


def missing_artifacts(expected: DataFrame, found: DataFrame, on) -> DataFrame:
    """Expected artifacts with no file found (left anti join against the
    distinct found paths)."""
    on = list(on)
    return expected.join(found.select(*on).distinct(), on, "left_anti")


def present_artifacts(expected: DataFrame, found: DataFrame, on) -> DataFrame:
    """Expected artifacts with at least one file found (left semi join; each
    expected row once, however many copies were found)."""
    on = list(on)
    return expected.join(found.select(*on), on, "left_semi")
