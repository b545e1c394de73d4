"""T5, verdicts: the lifecycle rules on one key's events, and the stream that gives verdicts only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

VERDICTS = np.array(["ok", "already_started", "not_started", "noop", "failed",
                     "still_running", None], dtype=object)


def judge_arrays(act, ok, started0: bool, stopped0: bool):
    """Verdicts of one key's actions in (time, id) order, given the flags before
    them: (verdicts, started_after, stopped_after).  Same rules as
    ``operators.lifecycle.lifecycle_check``."""
    is_start, is_stop, is_collect = act == "start", act == "stop", act == "collect"
    started_incl = np.logical_or.accumulate(is_start) | started0
    started = np.concatenate([[started0], started_incl[:-1]])
    stop_eff = is_stop & started & ok
    stopped_incl = np.logical_or.accumulate(stop_eff) | stopped0
    stopped = np.concatenate([[stopped0], stopped_incl[:-1]])
    code = np.full(len(act), 6)
    code[is_start] = np.where(started[is_start], 1, 0)
    code[is_stop] = np.where(~started[is_stop], 2,
                             np.where(stopped[is_stop], 3, np.where(ok[is_stop], 0, 4)))
    code[is_collect] = np.where(~started[is_collect], 2, np.where(~stopped[is_collect], 5, 0))
    return VERDICTS[code], bool(started_incl[-1]), bool(stopped_incl[-1])


def lifecycle_stream(stream: DataFrame, action, stop_ok=None, key="user_id", event_id: str = "event_id",
                     ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """``event_id``, the ``key`` columns (one or several, of any type), ``action``, ``verdict``; ``action`` maps
    rows to start / stop / collect (others dropped)."""
    from fleetlens.streaming.monitor import lifecycle_monitor
    keys = [key] if isinstance(key, str) else list(key)
    out = lifecycle_monitor(stream, action, F.lit(False), F.lit(False), F.lit(None), key=keys, event_id=event_id, ts=ts,
                            lateness=lateness, stop_ok=stop_ok, outcomes=False)
    return out.select(event_id, *keys, "action", F.col("outcome").alias("verdict"))
