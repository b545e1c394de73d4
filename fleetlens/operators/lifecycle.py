"""Task lifecycle from recorded events.

* T1 ``current_status``: never started -> (idle, null); started and no exit
  seen -> (running, null); exit seen -> (idle, returncode).  The last
  lifecycle event per task is a ``max_by`` aggregate (partial aggregation on
  the map side), so a task with very many events is not one task's work.
* T2 ``lifecycle_check``: a verdict per action.  ``start``: error if ever
  started (restarts are never allowed).  ``stop``: error if not started, no-op
  if already stopped.  ``collect``: error if not started or not stopped.
  Errors change no state; a failed stop leaves the task not stopped.  The
  sticky ``started`` / ``stopped`` flags are running "any" over the rows
  strictly before the current one, computed as segmented scans
  (``plans.scan``) so a task with very many events spreads over tasks.
* T3 ``launch_probe``: a start succeeds only if no exit follows within the
  grace time (5 s local, 11 s remote); an exit inside the grace is a failed
  launch even with code 0.
* T4 ``stop_escalation``: delay from a stop request to the exit: already idle
  -> ``already_exited``; within the terminate wait -> ``terminated``; within
  terminate + kill wait -> ``killed``; later or never -> ``not_stopped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.fixed import KILL_WAIT_S, STATUS_IDLE, STATUS_RUNNING, TERMINATE_WAIT_S
from fleetlens.operators.asof import next_event
from fleetlens.plans.scan import B, HOT, HOT_ROWS, bucketize, prefix_scan

US = 1_000_000


def current_status(events: DataFrame, key, order, is_start: Column, is_exit: Column,
                   returncode: Column, tasks: DataFrame | None = None) -> DataFrame:
    key, order = list(key), list(order)
    last = (events.filter(is_start | is_exit)
                  .groupBy(*key)
                  .agg(F.max_by(F.struct(is_start.alias("s"), returncode.cast("int").alias("rc")),
                                F.struct(*[F.col(c) for c in order])).alias("_cs_last")))
    if tasks is not None:
        last = tasks.select(*key).join(last, key, "left")
    s = F.col("_cs_last.s")
    return last.select(
        *key,
        F.when(F.col("_cs_last").isNull() | ~s, F.lit(STATUS_IDLE))
         .otherwise(F.lit(STATUS_RUNNING)).alias("status"),
        F.when(~s, F.col("_cs_last.rc")).alias("returncode"))


def lifecycle_check(events: DataFrame, key, order, action: Column,
                    stop_ok: Column | None = None, verdict: str = "verdict",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """``action`` maps each row to ``start`` / ``stop`` / ``collect`` (other
    values and nulls are left out).  ``stop_ok`` (default true) says whether a
    legal stop succeeded."""
    key, order = list(key), list(order)
    ok = F.lit(True) if stop_ok is None else F.coalesce(stop_ok, F.lit(False))
    x = (events.withColumn("action", action).filter(F.col("action").isNotNull())
               .withColumn("_lc_ok", ok))
    b = bucketize(x, key, order, hot_rows)
    x = prefix_scan(b, key, order, [("started", "or", F.col("action") == "start")])
    x = x.withColumn("started", F.coalesce(F.col("started"), F.lit(False)))
    x = x.withColumn("_lc_stop", (F.col("action") == "stop") & F.col("started") & F.col("_lc_ok"))
    x = prefix_scan(x, key, order, [("stopped", "or", F.col("_lc_stop"))])
    x = x.withColumn("stopped", F.coalesce(F.col("stopped"), F.lit(False)))
    a, st, sp = F.col("action"), F.col("started"), F.col("stopped")
    v = (F.when(a == "start", F.when(st, "already_started").otherwise("ok"))
          .when(a == "stop", F.when(~st, "not_started").when(sp, "noop")
                              .when(F.col("_lc_ok"), "ok").otherwise("failed"))
          .when(a == "collect", F.when(~st, "not_started").when(~sp, "still_running")
                                 .otherwise("ok")))
    return x.withColumn(verdict, v).drop("_lc_ok", "_lc_stop", B, HOT)


def launch_probe(events: DataFrame, key, order, is_start: Column, is_exit: Column,
                 returncode: str, grace_s, ts: str = "ts", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Start rows plus ``launched`` and ``returncode`` (the exit code of a
    failed launch).  ``grace_s`` is a number or a column (seconds)."""
    g = (grace_s if isinstance(grace_s, Column) else F.lit(grace_s)).cast("bigint")
    x = next_event(events, key, order, is_start, is_exit, carry=[returncode], ts=ts,
                   hot_rows=hot_rows)
    inside = F.col("delay_us").isNotNull() & (F.col("delay_us") <= g * F.lit(US))
    return (x.withColumn("launched", ~inside)
             .withColumn("returncode", F.when(inside, F.col(f"next_{returncode}").cast("int"))))


def stop_escalation(events: DataFrame, key, order, is_stop: Column, is_exit: Column,
                    term_s=TERMINATE_WAIT_S, kill_s=KILL_WAIT_S,
                    already_idle: Column | None = None, ts: str = "ts",
                    hot_rows: int = HOT_ROWS, is_start: Column | None = None) -> DataFrame:
    """Stop-request rows plus ``outcome``.  ``already_idle`` says of each whether its task had exited; with
    ``is_start`` that is taken from the events: the last start or exit before the request is an exit."""
    key, order = list(key), list(order)
    t = (term_s if isinstance(term_s, Column) else F.lit(term_s)).cast("bigint")
    k = (kill_s if isinstance(kill_s, Column) else F.lit(kill_s)).cast("bigint")
    if already_idle is not None:
        events = events.withColumn("_se_idle", already_idle)
    elif is_start is not None:
        life = events.filter(is_stop | is_start | is_exit)
        last = F.when(is_start | is_exit, is_exit)
        events = prefix_scan(bucketize(life, key, order, hot_rows, base=life), key, order, [("_se_idle", "last", last)]).drop(B, HOT)
    x = next_event(events, key, order, is_stop, is_exit, carry=[], ts=ts, hot_rows=hot_rows)
    d = F.col("delay_us")
    out = F.when(d.isNull(), "not_stopped") \
           .when(d <= t * F.lit(US), "terminated") \
           .when(d <= (t + k) * F.lit(US), "killed") \
           .otherwise("not_stopped")
    if "_se_idle" in x.columns:
        out = F.when(F.coalesce(F.col("_se_idle"), F.lit(False)), "already_exited").otherwise(out)
    return x.withColumn("outcome", out).drop("_se_idle")
