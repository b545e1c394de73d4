"""T5 (full): streaming lifecycle monitor with event-time deadlines.

Events may arrive out of order within the watermark's ``lateness``.  A row waits in its key's
state until the watermark has passed it: from then on no earlier row can come, so
rows are judged in (time, id) order whatever the order of arrival.  Emitted are:

* ``verdict`` rows: the lifecycle verdict of each start / stop / collect
  (same rules as ``operators.lifecycle.lifecycle_check``);
* ``launch`` rows: a start whose next exit comes within ``grace`` is
  ``launch_failed`` (with the exit's return code), otherwise ``launched``;
* ``stop`` rows: a stop request whose next exit comes within ``term`` is
  ``terminated``, within ``term + kill`` ``killed``, otherwise
  ``not_stopped``;
* ``status`` rows: the current status (T1) after the rows judged together: ``running`` after
  a start, ``idle`` with the return code after an exit, ``idle`` when never
  started; the event id is the last one judged.

An open start or stop is settled by the next exit, or by the
watermark passing its deadline (an event-time timeout, re-armed to the
earliest waiting row or open deadline).  At the end of a finite stream the rows within the
last ``lateness`` still wait.

With ``already_exited``, a stop request of a task whose last start or exit before it is an exit is
``already_exited`` (T4), at once.

No state value grows with a key.  Waiting rows lie in *leaves*, entries of a map by the time that each begins at; a
leaf of more than ``LEAF`` rows is cut in two at its median time, so an entry holds at most that many (and those of one
microsecond).  Rows are judged leaf by leaf, in order, with only the flags carried on, and written out as they are judged.  Open starts and
stops lie in packs of at most ``LEAF`` in the order of time.  So a task needs memory for a leaf and an Arrow batch of input, also for a
key with a third of all rows in one micro-batch.

Rows behind the watermark are dropped by Spark, so a limit per trigger is for files that come in the order of time.  State never
expires while a task runs; with ``ttl_s``, that of a task that was started and stopped is
dropped so long after its last event (a later event finds an unknown task).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (BinaryType, BooleanType, IntegerType, LongType, StringType,
                               StructField, StructType)

from fleetlens.fixed import KILL_WAIT_S, TERMINATE_WAIT_S
from fleetlens.functions.times import ntz_to_instant
from fleetlens.streaming.lifecycle import judge_arrays

US = 1_000_000
LEAF = 4096
NEVER, RUNNING, EXITED = 0, 1, 2  # current status
_ROWS = ["lm_id", "lm_us", "action", "launch_exit", "stop_exit", "rc", "stop_ok"]
_FLAGS = StructType([
    StructField("started", BooleanType()), StructField("stopped", BooleanType()), StructField("last_us", LongType()),
    StructField("cur", IntegerType()), StructField("cur_rc", IntegerType()), StructField("timer_ms", LongType()),
    # packs of open items: the first and the next number, and the first one's earliest time
    *[StructField(f"{k}_{x}", LongType()) for k in ("launch", "stop") for x in ("first", "next", "us")]])
_PLACE, _PACK = StructType([StructField("at", LongType())]), StructType([StructField("rows", BinaryType())])


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(value[0]))).read_all()


class Monitor(StatefulProcessor):
    """The monitor of one key; waits in microseconds.  ``outcomes``: whether launches, stops and the status are given as well."""

    def __init__(self, keys: list[str], id_name: str, types: pa.Schema, grace: int, term: int, kill: int, ttl: int | None,
                 already_exited: bool, outcomes: bool, leaf: int = LEAF):
        self.keys, self.id_name, self.types, self.leaf = keys, id_name, types, leaf
        self.wait = {"launch": grace, "stop": term + kill}
        self.term, self.ttl, self.already_exited, self.outcomes = term, ttl, already_exited, outcomes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", _FLAGS)
        self.leaves = handle.getMapState("leaves", _PLACE, _PACK)
        self.open = {k: handle.getMapState(f"open_{k}", _PLACE, _PACK) for k in ("launch", "stop")} if self.outcomes else {}

    def close(self) -> None:
        pass

    # ---- waiting rows

    def _insert(self, places: list[int], rows: pa.Table) -> list[int]:
        """Puts rows (in the order of time) into their leaves; returns where leaves begin."""
        us, stored = rows.column("lm_us").to_numpy(), bool(places)
        if not places:
            places = [int(us[0])]
        of = np.maximum(np.searchsorted(np.array(places), us, "right") - 1, 0)
        out = []
        for n, place in enumerate(places):
            a, b = np.searchsorted(of, [n, n + 1])
            if a == b:
                out.append(place)
                continue
            own, at = rows.slice(a, b - a), min(place, int(us[a]))
            if stored:
                own = pa.concat_tables([_unpacked(self.leaves.getValue((place,))), own])
                own = own.take(pa.array(np.argsort(own.column("lm_us").to_numpy(), kind="stable")))
                if at != place:
                    self.leaves.removeKey((place,))
            time, begin = own.column("lm_us").to_numpy(), 0
            while begin < len(time):  # one leaf, or as many of half the size as it takes
                end = len(time) if len(time) - begin <= self.leaf else int(np.searchsorted(time, time[begin + self.leaf // 2], "left"))
                if end <= begin:  # so many rows of one microsecond
                    end = int(np.searchsorted(time, time[begin], "right"))
                at = at if begin == 0 else int(time[begin])
                self.leaves.updateValue((at,), _packed(own.slice(begin, end - begin)))
                out.append(at)
                begin = end
        return out

    # ---- open starts and stops

    def _add_open(self, f: dict, kind: str, ids: pa.Array, us: np.ndarray) -> None:
        for a in range(0, len(us), self.leaf):
            if f[f"{kind}_first"] == f[f"{kind}_next"]:
                f[f"{kind}_us"] = int(us[a])
            self.open[kind].updateValue((f[f"{kind}_next"],), _packed(pa.table({"id": ids.slice(a, self.leaf), "us": us[a:a + self.leaf]})))
            f[f"{kind}_next"] += 1

    def _settle(self, f: dict, kind: str, exit_us: int | None, rc, wm: int):
        """Outcomes of the open items: of all by an exit, or of those whose deadline the watermark has passed."""
        while f[f"{kind}_first"] < f[f"{kind}_next"]:
            if exit_us is None and f[f"{kind}_us"] + self.wait[kind] > wm:
                return
            pack = _unpacked(self.open[kind].getValue((f[f"{kind}_first"],)))
            us = pack.column("us").to_numpy()
            n = len(us) if exit_us is not None else int(np.searchsorted(us, wm - self.wait[kind], "right"))
            delay = np.full(n, np.iinfo(np.int64).max) if exit_us is None else exit_us - us[:n]
            yield self._outcomes(kind, pack.column("id").slice(0, n), delay, [rc] * n)
            if n < len(us):
                self.open[kind].updateValue((f[f"{kind}_first"],), _packed(pack.slice(n)))
                f[f"{kind}_us"] = int(us[n])
                return
            self.open[kind].removeKey((f[f"{kind}_first"],))
            f[f"{kind}_first"] += 1
            if f[f"{kind}_first"] < f[f"{kind}_next"]:
                f[f"{kind}_us"] = int(_unpacked(self.open[kind].getValue((f[f"{kind}_first"],))).column("us")[0].as_py())

    def _outcomes(self, kind: str, ids, delay: np.ndarray, rc: list) -> tuple[list, ...]:
        if kind == "launch":
            failed = delay <= self.wait[kind]
            return self._part(ids, kind, None, np.where(failed, "launch_failed", "launched"), [r if x else None for r, x in zip(rc, failed)])
        late = np.where(delay <= self.wait[kind], "killed", "not_stopped")
        return self._part(ids, kind, None, np.where(delay <= self.term, "terminated", late), None)

    @staticmethod
    def _part(ids, kind: str, actions, outcomes, rcs) -> tuple[list, ...]:
        """Rows of the result, by columns: id, kind, action, outcome, return code."""
        n = len(ids)
        listed = ids.to_pylist() if isinstance(ids, (pa.Array, pa.ChunkedArray)) else list(ids)
        return listed, [kind] * n, [None] * n if actions is None else list(actions), list(outcomes), [None] * n if rcs is None else rcs

    def _frames(self, key, parts):
        """Frames of at most a leaf's rows (or one part's): each costs Spark an Arrow batch, so a small key gives one."""
        held, n = [], 0
        for part in parts:
            if held and n + len(part[0]) > self.leaf:
                yield self._frame(key, held)
                held, n = [], 0
            if part[0]:
                held.append(part)
                n += len(part[0])
        if held:
            yield self._frame(key, held)

    def _frame(self, key, parts: list) -> pd.DataFrame:
        ids, kinds, actions, outcomes, rcs = ([x for c in cols for x in c] for cols in zip(*parts))
        index = pd.RangeIndex(len(ids))

        def column(values, text: bool = True):
            # as objects: pandas' own strings may come in several chunks, which Spark's serializer does not take
            return pd.Series(values, index, dtype=object if text else None)

        data = {k: column([v] * len(ids), isinstance(v, str)) for k, v in zip(self.keys, key)}
        data |= {self.id_name: column(ids, isinstance(ids[0], str) or None in ids), "kind": column(kinds), "action": column(actions), "outcome": column(outcomes),
                 "returncode": pd.array(rcs, dtype="Int32")}
        return pd.DataFrame(data, index)

    # ---- judging

    def _judge(self, f: dict, rows: pa.Table, wm: int):
        """What follows from rows that the watermark has passed, of one leaf."""
        rows = rows.sort_by([("lm_us", "ascending"), ("lm_id", "ascending")])
        ids, us = rows.column("lm_id").combine_chunks(), rows.column("lm_us").to_numpy()
        act = np.array(rows.column("action").to_pylist(), dtype=object)
        has = np.array([a is not None for a in act], dtype=bool)
        if has.any():
            ok = rows.column("stop_ok").to_numpy()
            v, f["started"], f["stopped"] = judge_arrays(act[has], ok[has], f["started"], f["stopped"])
            yield self._part(ids.filter(pa.array(has)), "verdict", act[has], v, None)
        f["last_us"] = int(us[-1])
        if not self.outcomes:
            return
        rc = rows.column("rc").to_pylist()
        launch_exit = rows.column("launch_exit").to_numpy()
        life = (act == "start") | launch_exit
        # whether the last start or exit ahead of each row is an exit
        before = np.maximum.accumulate(np.where(life, np.arange(len(us)), -1))
        before = np.concatenate([[-1], before[:-1]])
        idle = np.where(before >= 0, act[before] != "start", f["cur"] == EXITED)
        for kind, word, exits in (("launch", "start", np.flatnonzero(launch_exit)), ("stop", "stop", np.flatnonzero(rows.column("stop_exit").to_numpy()))):
            items = np.flatnonzero(act == word)
            if kind == "stop" and self.already_exited and idle[items].any():
                gone = items[idle[items]]
                items = items[~idle[items]]
                yield self._part(ids.take(pa.array(gone)), kind, None, ["already_exited"] * len(gone), None)
            if len(exits):
                yield from self._settle(f, kind, int(us[exits[0]]), rc[exits[0]], wm)
            # the first exit behind each item: an item is no exit for itself
            k = np.searchsorted(exits, items, "right")
            met = k < len(exits)
            if met.any():
                at = exits[k[met]]
                yield self._outcomes(kind, ids.take(pa.array(items[met])), us[at] - us[items[met]], [rc[i] for i in at])
            if not met.all():
                self._add_open(f, kind, ids.take(pa.array(items[~met])), us[items[~met]])
        if life.any():
            last = int(np.flatnonzero(life)[-1])
            f["cur"] = RUNNING if act[last] == "start" else EXITED
            f["cur_rc"] = None if f["cur"] == RUNNING else rc[last]
        self.judged = ids[-1].as_py()

    def _run(self, key, batches, wm_ms: int):
        return self._frames(key, self._parts(batches, wm_ms))

    def _parts(self, batches, wm_ms: int):
        wm, held = wm_ms * 1000, self.flags.get() if self.flags.exists() else None
        f = dict(zip(_FLAGS.names, held)) if held else dict.fromkeys(_FLAGS.names, 0) | {
            "started": False, "stopped": False, "last_us": None, "cur_rc": None, "timer_ms": None}
        self.judged = None
        places = sorted(k[0] for k in self.leaves.keys()) if held else []
        for pdf in batches:
            if len(pdf):
                rows = pa.Table.from_arrays([pa.Array.from_pandas(pdf[c], type=t) for c, t in zip(_ROWS, self.types.types)], schema=self.types)
                places = self._insert(places, rows.take(pa.array(np.argsort(rows.column("lm_us").to_numpy(), kind="stable"))))
        while places and places[0] <= wm:
            rows = _unpacked(self.leaves.getValue((places[0],)))
            us = rows.column("lm_us").to_numpy()
            n = int(np.searchsorted(us, wm, "right"))
            if n:
                yield from self._judge(f, rows.slice(0, n), wm)
            self.leaves.removeKey((places[0],))
            places = places[1:]
            if n < len(us):
                places = [int(us[n]), *places]
                self.leaves.updateValue((places[0],), _packed(rows.slice(n)))
                break
        if self.judged is not None:
            yield self._part([self.judged], "status", None, ["running" if f["cur"] == RUNNING else "idle"], [f["cur_rc"]])
        due = places[:1]
        for kind in self.open:
            yield from self._settle(f, kind, None, None, wm)
            if f[f"{kind}_first"] < f[f"{kind}_next"]:
                due.append(f[f"{kind}_us"] + self.wait[kind])
        if self.ttl is not None and f["started"] and f["stopped"] and not due:
            if f["last_us"] + self.ttl <= wm:
                self._arm(f, None, wm_ms)
                self.flags.clear()
                return
            due = [f["last_us"] + self.ttl]
        self._arm(f, min(due) if due else None, wm_ms)
        self.flags.update(tuple(f[n] for n in _FLAGS.names))

    def _arm(self, f: dict, due_us: int | None, wm_ms: int) -> None:
        """One timer, at the next time that something is due; it fires once the watermark is past it, so a millisecond before."""
        at = None if due_us is None else max(-(-due_us // 1000) - 1, wm_ms + 1)
        if f["timer_ms"] is not None and f["timer_ms"] != at and f["timer_ms"] > wm_ms:
            self.handle.deleteTimer(f["timer_ms"])
        if at is not None and at != f["timer_ms"]:
            self.handle.registerTimer(at)
        f["timer_ms"] = at

    def handleInputRows(self, key, rows, timerValues):
        yield from self._run(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._run(key, (), timerValues.getCurrentWatermarkInMs())


def lifecycle_monitor(stream: DataFrame, action: Column, launch_exit: Column, stop_exit: Column,
                      returncode: Column, grace_s=5, term_s=TERMINATE_WAIT_S, kill_s=KILL_WAIT_S,
                      key="user_id", event_id: str = "event_id", ts: str = "ts", lateness: str = "1 hour",
                      stop_ok: Column | None = None, ttl_s: int | None = None, already_exited: bool = False,
                      outcomes: bool = True, leaf: int = LEAF) -> DataFrame:
    """``stream`` has ``event_id``, the ``key`` columns (one or several) and ``ts``, of any types.  ``action`` maps
    rows to start / stop / collect; ``launch_exit`` / ``stop_exit`` say which rows
    end a launch probe / a stop request; ``returncode`` is the exit code.  Without ``outcomes``, verdicts only.

    Returns the key columns, the event id, ``kind``, ``action`` (of verdicts), ``outcome``, ``returncode``."""
    keys = [key] if isinstance(key, str) else list(key)
    fields = stream.schema
    t = ntz_to_instant(ts) if fields[ts].dataType.typeName() == "timestamp_ntz" else F.col(ts)
    x = stream.select(
        *keys, F.col(event_id).alias("lm_id"), t.alias("lm_ts"), action.alias("action"),
        F.coalesce(launch_exit, F.lit(False)).alias("launch_exit"), F.coalesce(stop_exit, F.lit(False)).alias("stop_exit"),
        returncode.cast("int").alias("rc"),
        (F.lit(True) if stop_ok is None else F.coalesce(stop_ok, F.lit(False))).alias("stop_ok"))
    x = x.filter(F.col("action").isNotNull() | F.col("launch_exit") | F.col("stop_exit")) \
         .withColumn("lm_us", F.unix_micros("lm_ts")).withWatermark("lm_ts", lateness)
    out = StructType([*[StructField(k, fields[k].dataType) for k in keys], StructField(event_id, fields[event_id].dataType),
                      StructField("kind", StringType()), StructField("action", StringType()),
                      StructField("outcome", StringType()), StructField("returncode", IntegerType())])
    types = to_arrow_schema(x.select(*_ROWS).schema)
    processor = Monitor(keys, event_id, types, int(grace_s * US), int(term_s * US), int(kill_s * US), None if ttl_s is None else int(ttl_s * US),
                        already_exited, outcomes, leaf)
    return x.groupBy(*keys).transformWithStateInPandas(processor, out, "append", "eventTime")
