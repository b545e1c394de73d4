"""Defaults for absent keys and run-time overrides.

``dict.get(k, default)`` semantics: only an **absent** key takes the default; a
key that is present with a null value stays null.  An override wins whenever
it is not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def map_value(m, key: str, default=None) -> Column:
    """``m.get(key, default)``: absent -> default, present null -> null."""
    m = F.col(m) if isinstance(m, str) else m
    return F.when(m.isNull() | ~F.map_contains_key(m, F.lit(key)), _lit(default)) \
            .otherwise(F.element_at(m, F.lit(key)))


def apply_map_defaults(df: DataFrame, map_col, defaults: dict,
                       overrides: dict | None = None, prefix: str = "") -> DataFrame:
    """One column per key of ``defaults`` read from a map column."""
    overrides = overrides or {}
    for k, d in defaults.items():
        v = map_value(map_col, k, d)
        if k in overrides:
            v = F.coalesce(_lit(overrides[k]), v)
        df = df.withColumn(prefix + k.lstrip("-"), v)
    return df


def apply_defaults(df: DataFrame, present, defaults: dict,
                   overrides: dict | None = None, present_col: str | None = "present") -> DataFrame:
    """Column form: ``present`` (a boolean column) says whether the source
    record exists; where it does not, each column of ``defaults`` takes its
    default, where it does the value is kept (null included).  Then each
    override column wins where it is not null."""
    p = F.col(present) if isinstance(present, str) else present
    overrides = overrides or {}
    for c, d in defaults.items():
        df = df.withColumn(c, F.when(p, F.col(c)).otherwise(_lit(d)))
    for c, o in overrides.items():
        df = df.withColumn(c, F.coalesce(_lit(o), F.col(c)))
    if present_col:
        df = df.withColumn(present_col, p)
    return df
