"""Start and stop order of tasks, and the nominal timeline.

Tasks start in ascending position and stop in reverse.  ``stop_order`` is
documented but the spec runner always reverses; ``honor_stop_order=False`` is
that behaviour, ``True`` stops tasks that have a ``stop_order`` first
(ascending), then the rest in reverse position.

The timeline gives each task its nominal start, ready and stop offsets: each
start costs its probe wait plus its sleep; then the experiment runs for
``stop_after``; then tasks stop in stop order, each followed by its sleep.  It
is a lower bound (directory creation, polling and copy time are not known).

Both are running aggregates over one run, computed as segmented scans
(``plans.scan``): a run with very many tasks is cut into buckets of its
order, each its own task.  With ``honor_stop_order=True`` the stop side is a second
scan, over (has a stop order, minus the stop order, position) from the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.plans.scan import B, HOT, HOT_ROWS, bucketize, prefix_scan

HAS, NEG = "_so_has", "_so_neg"


def _scans(tasks: DataFrame, key, order, measures, stop_order: str | None, stop_measures, hot_rows: int) -> DataFrame:
    """One scan in start order and, with ``stop_order``, one in stop order.

    Tasks with a ``stop_order`` stop first, ascending, then the rest in reverse; written as a
    descending order, so that the reverse needs no negated columns."""
    x = tasks
    if stop_order:
        x = x.withColumn(HAS, F.col(stop_order).isNotNull()).withColumn(NEG, -F.col(stop_order).cast("bigint"))
    base = x
    x = prefix_scan(bucketize(x, key, order, hot_rows), key, order, measures).drop(B, HOT)
    if stop_order:
        by = [HAS, NEG, *order]
        x = prefix_scan(bucketize(x, key, by, hot_rows, base=base), key, by, stop_measures, descending=True).drop(HAS, NEG, B, HOT)
    return x


def _rank_measures():
    return [("_ot_up", "count", None), ("_ot_n", "total", F.lit(1).cast("bigint"))], [("_ot_stop", "count", None)]


def _ranks(x: DataFrame, honoured: bool, start_rank: str, stop_rank: str) -> DataFrame:
    # the order is total, so the plain stop order (its reverse) needs no second
    # sort: stop rank = tasks in the run - tasks before
    stop = F.col("_ot_stop") + 1 if honoured else F.col("_ot_n") - F.col("_ot_up")
    return (x.withColumn(start_rank, (F.col("_ot_up") + 1).cast("bigint"))
             .withColumn(stop_rank, stop.cast("bigint")).drop("_ot_up", "_ot_n", "_ot_stop"))


def order_tasks(tasks: DataFrame, key, order, honor_stop_order: bool = False,
                stop_order: str | None = "stop_order",
                start_rank: str = "start_rank", stop_rank: str = "stop_rank",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    key, order = list(key), list(order)
    stop_order = stop_order if honor_stop_order else None
    up, stop = _rank_measures()
    return _ranks(_scans(tasks, key, order, up, stop_order, stop, hot_rows), bool(stop_order), start_rank, stop_rank)


def timeline(tasks: DataFrame, key, order, start_cost: Column, stop_cost: Column,
             stop_after, ready_offset: Column | None = None,
             honor_stop_order: bool = False, stop_order: str | None = "stop_order",
             ranks: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``start_at``, ``ready_at`` and ``stop_at`` (same unit as the
    costs).  ``ready_offset`` (default: the whole start cost) is the part of
    the start cost after which the task counts as ready.  ``ranks``: also the ranks of
    ``order_tasks``, from the same scans."""
    key, order = list(key), list(order)
    stop_order = stop_order if honor_stop_order else None
    sa = stop_after if isinstance(stop_after, Column) else F.lit(stop_after)
    ro = start_cost if ready_offset is None else ready_offset
    x = tasks.withColumn("_tl_sc", start_cost).withColumn("_tl_pc", stop_cost) \
             .withColumn("_tl_ro", ro)
    # without stop orders one ascending scan will do: the wait before a task's stop (stops run in
    # reverse) is the run's stop cost minus that of the task and the
    # tasks before it
    up = [("_tl_before", "sum", F.col("_tl_sc")), ("_tl_total", "total", F.col("_tl_sc")),
          ("_tl_pbefore", "sum", F.col("_tl_pc")), ("_tl_ptotal", "total", F.col("_tl_pc"))]
    stop = [("_tl_stopwait", "sum", F.col("_tl_pc"))]
    if ranks:
        more_up, more_stop = _rank_measures()
        up, stop = up + more_up, stop + more_stop
    x = _scans(x, key, order, up, stop_order, stop, hot_rows)
    if ranks:
        x = _ranks(x, bool(stop_order), "start_rank", "stop_rank")
    if not stop_order:
        z = F.lit(0)
        x = x.withColumn("_tl_stopwait", F.coalesce(F.col("_tl_ptotal"), z)
                         - F.coalesce(F.col("_tl_pbefore"), z) - F.coalesce(F.col("_tl_pc"), z))
    x = (x.withColumn("start_at", F.coalesce(F.col("_tl_before"), F.lit(0)))
          .withColumn("ready_at", F.col("start_at") + F.col("_tl_ro"))
          .withColumn("stop_at", F.col("_tl_total") + sa + F.coalesce(F.col("_tl_stopwait"), F.lit(0))))
    return x.drop("_tl_sc", "_tl_pc", "_tl_ro", "_tl_before", "_tl_total", "_tl_pbefore", "_tl_ptotal", "_tl_stopwait")
