"""Route rows by type through a registry, and validate them.

The spec runner dispatches on ``obj_type`` and ``runner_type``; an unknown
type yields nothing and a missing required key crashes later.  Here every row
goes to exactly one of two outputs: ``accepted`` or ``rejects`` with the
reasons.  Nothing is dropped silently.

The registry is a small table (one row per known type) broadcast to the
scan: no shuffle of the routed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from fleetlens.plans.broadcast import literal_table

REGISTRY_SCHEMA = StructType([
    StructField("type", StringType(), False),
    StructField("handler", StringType(), True),
    StructField("required", ArrayType(StringType()), True),
])


def registry(spark: SparkSession, entries: dict) -> DataFrame:
    """``{type: (handler, [required keys])}`` -> broadcast registry table."""
    rows = [(t, h, list(req)) for t, (h, req) in entries.items()]
    return literal_table(spark, rows, REGISTRY_SCHEMA)


def route(df: DataFrame, reg: DataFrame, type_col: str, map_col=None,
          checks=(), reason: str = "reason", handler: str = "handler") -> DataFrame:
    """Every row of ``df`` plus ``handler``, ``accepted`` and ``reason``.

    :param reg: registry table (``type``, ``handler``, ``required``).
    :param map_col: map whose keys must include the type's ``required`` keys.
    :param checks: extra ``(reason_text, ok_column)`` pairs; a false check
        adds its reason (a null check counts as failed).
    """
    r = reg.select(F.col("type").alias("_rt_type"), F.col("handler").alias(handler),
                   F.col("required").alias("_rt_req"))
    j = df.join(r, F.col(type_col) == F.col("_rt_type"), "left")
    reasons = [F.when(F.col("_rt_type").isNull(),
                      F.concat(F.lit("unknown_type:"), F.coalesce(F.col(type_col), F.lit("null"))))]
    if map_col is not None:
        m = F.col(map_col) if isinstance(map_col, str) else map_col
        missing = F.filter(F.coalesce(F.col("_rt_req"), F.array().cast("array<string>")),
                           lambda k: m.isNull() | ~F.map_contains_key(m, k))
        reasons.append(F.when(F.size(missing) > 0,
                              F.concat(F.lit("missing_key:"), F.array_join(missing, ","))))
    for text, ok in checks:
        reasons.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)))
    arr = F.array_compact(F.array(*reasons))
    return (j.withColumn("_rt_reasons", arr)
             .withColumn("accepted", F.size("_rt_reasons") == 0)
             .withColumn(reason, F.when(F.size("_rt_reasons") > 0,
                                        F.array_join("_rt_reasons", ";")))
             .drop("_rt_type", "_rt_req", "_rt_reasons"))


def route_specs(df: DataFrame, reg: DataFrame, type_col: str, map_col=None,
                checks=()) -> tuple[DataFrame, DataFrame]:
    """Two outputs: ``(accepted, rejects)``; rejects carry ``reason``."""
    r = route(df, reg, type_col, map_col, checks)
    return r.filter("accepted").drop("reason"), r.filter("NOT accepted")
