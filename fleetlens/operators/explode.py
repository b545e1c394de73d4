"""Ordered explosion of task maps and parameter maps.

Start order is the entry order of the ``tasks`` map in the spec file, not the
numeric order of the keys, and order does not survive a shuffle, so the
position is taken from ``posexplode`` right at the scan (a narrow operation:
no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType, StructType


def explode_ordered(df: DataFrame, map_col: str, pos: str = "pos",
                    key: str = "key", value: str = "value",
                    keep=None) -> DataFrame:
    """``map`` -> rows ``(keep..., pos, key, value)`` in entry order.

    Null values are kept (a null option value is a bare flag, not an absent
    one); a null or empty map yields no rows.
    """
    keep = [c for c in df.columns if c != map_col] if keep is None else list(keep)
    return _posexplode(df, keep, F.col(map_col), pos, key, value)


def _posexplode(df: DataFrame, keep, m, pos, key, value) -> DataFrame:
    # The outer form plus a null check on the position keeps the same rows as
    # posexplode, but stops Catalyst from inferring a size(map) > 0 filter and
    # pushing it below the projection, where it would evaluate the map
    # expression (e.g. a JSON parse) a second time.
    return (df.select(*keep, F.posexplode_outer(m).alias(pos, key, value))
              .filter(F.col(pos).isNotNull()))


def explode_params(df: DataFrame, map_col, keep, pos: str = "pos",
                   key: str = "key", value: str = "value") -> DataFrame:
    """One row per parameter of an ordered ``map<string,string>``
    column (a column name or expression)."""
    m = F.col(map_col) if isinstance(map_col, str) else map_col
    return _posexplode(df, keep, m, pos, key, value)


def explode_tasks(specs: DataFrame, tasks: str = "tasks", run_cols=None,
                  task: str = "task", pos: str = "pos") -> DataFrame:
    """One row per task with its start position.

    Run-level columns (``run_cols``, default: every column but ``tasks``) are
    stamped onto each task, and the task key is copied to ``prefix``.  A
    struct-valued task is expanded to its fields; any other value type is
    kept as ``task_config``.
    """
    run_cols = [c for c in specs.columns if c != tasks] if run_cols is None else list(run_cols)
    vtype = specs.schema[tasks].dataType
    if not isinstance(vtype, MapType):
        raise TypeError(f"{tasks} must be a map, got {vtype.simpleString()}")
    x = explode_ordered(specs, tasks, pos=pos, key=task, value="_task", keep=run_cols)
    if isinstance(vtype.valueType, StructType):
        fields = [F.col(f"_task.{f.name}").alias(f.name) for f in vtype.valueType.fields]
    else:
        fields = [F.col("_task").alias("task_config")]
    return x.select(*run_cols, pos, task, *fields, F.col(task).alias("prefix"))
