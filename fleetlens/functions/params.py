"""Render ordered parameters as ``k=v&k=v``.

A null value renders as the text ``None`` by default (the spec runner formats
values with Python string formatting); pass ``null_text=None`` to drop such
pairs instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.fixed import NULL_TEXT, PARAM_SEPARATOR


def _pair(k: Column, v: Column, null_text) -> Column:
    if null_text is None:
        return F.concat(k, F.lit("="), v)
    return F.concat(k, F.lit("="), F.coalesce(v.cast("string"), F.lit(null_text)))


def render_map(m, null_text=NULL_TEXT, sep: str = PARAM_SEPARATOR) -> Column:
    """Row-local form: a ``map<string,string>`` in entry order."""
    m = F.col(m) if isinstance(m, str) else m
    return F.array_join(
        F.transform(F.map_entries(m), lambda e: _pair(e["key"], e["value"], null_text)),
        sep)


def render_params(df: DataFrame, keys, order, key, value, null_text=NULL_TEXT,
                  sep: str = PARAM_SEPARATOR, out: str = "params") -> DataFrame:
    """Long form: one row per parameter, grouped by ``keys`` and joined in
    ``order`` with an ordered string aggregate.

    The result is one string per group by definition, so a group's pairs meet
    in one task at the final aggregation step (partial aggregation still runs
    per map task).
    """
    k = F.col(key) if isinstance(key, str) else key
    v = F.col(value) if isinstance(value, str) else value
    order_sql = ", ".join(f"`{c}`" for c in order)
    return (df.withColumn("_rp_kv", _pair(k.cast("string"), v, null_text))
              .groupBy(*keys)
              .agg(F.expr(f"listagg(_rp_kv, '{sep}') WITHIN GROUP (ORDER BY {order_sql})")
                   .alias(out)))
